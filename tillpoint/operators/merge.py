"""Keyed state without a table format: upsert / CDC apply and SCD-2.

Open-source Spark cannot ``MERGE INTO`` plain Parquet, so a merge is a
function from (current state, changes) to the new state; the caller writes
the result as a new snapshot (see :mod:`sources.sinks`).  Replaying the same
batch gives the same state (idempotent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import checked
from ..session import written
from .keys import orderable, spread_hot
from .sequence import last_known, next_value, prev_value, row_number_in_key


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order`` (a total order within the key), as
    an aggregate: ``max_by`` is combined map-side, so a hot key costs one
    partial row per map task, not a sort of all its rows in one task."""
    cols = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order])).alias("__r"))
    return latest.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in cols])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order_col: str,
           op_col: str | None = None, delete_value: str = "D", tombstones: bool = False) -> DataFrame:
    """Apply ``changes`` to ``current`` (schema of ``current``).

    Per key the latest change wins (last writer by ``order_col``; of changes
    with equal order values the largest by its other columns, and a change
    wins over a stored row).  A change older than
    the stored row is ignored.  With ``op_col``, a winning change whose op
    is ``delete_value`` removes the key.  With ``tombstones`` the removed key
    stays in the state as a row flagged ``_deleted`` (with its order value),
    so a change that arrives later but is older than the delete cannot
    bring the key back; readers filter ``NOT _deleted``.
    """
    cols = [c for c in current.columns if c != TOMBSTONE]
    extra = [op_col] if op_col else []
    ties = [f.name for f in changes.select(*cols, *extra).schema.fields
            if f.name not in (order_col, *keys) and orderable(f.dataType)]
    ch = latest_per_key(changes.select(*cols, *extra), keys, [order_col, *ties])
    cur_del = F.col(TOMBSTONE) if TOMBSTONE in current.columns else F.lit(False)
    c = current.select(*[F.col(x).alias(f"__c_{x}") for x in cols], F.lit(True).alias("__c_here"),
                       F.coalesce(cur_del, F.lit(False)).alias("__c_del"))
    n = ch.select(*[F.col(x).alias(f"__n_{x}") for x in cols + extra], F.lit(True).alias("__n_here"))
    cond = [c[f"__c_{k}"].eqNullSafe(n[f"__n_{k}"]) for k in keys]
    j = c.join(n, cond, "full_outer")
    has_new = F.col("__n_here").isNotNull()
    has_cur = F.col("__c_here").isNotNull()
    newer = F.col(f"__c_{order_col}").isNull() | (F.col(f"__n_{order_col}") >= F.col(f"__c_{order_col}"))
    take_new = has_new & (~has_cur | newer)
    new_del = F.coalesce(F.col(f"__n_{op_col}") == delete_value, F.lit(False)) if op_col else F.lit(False)
    deleted = F.when(take_new, new_del).otherwise(F.coalesce(F.col("__c_del"), F.lit(False)))
    out = j.select(*[F.when(take_new, F.col(f"__n_{x}")).otherwise(F.col(f"__c_{x}")).alias(x)
                     for x in cols], deleted.alias(TOMBSTONE))
    return out if tombstones else out.filter(~F.col(TOMBSTONE)).drop(TOMBSTONE)


TOMBSTONE = "_deleted"


def record_hash(cols: list[str]) -> Column:
    """Change-detection hash of tracked attributes (NULL-safe, typed)."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols])), 256)


def history_id(key: str, stride: int = 1_000_000) -> Column:
    """key * stride + version; the job fails on a version that would run
    into the next key."""
    return checked(F.col(key).cast("bigint") * stride + F.col("version"), F.col("version") < stride,
                   f"more than {stride - 1} versions of one key: choose a larger id stride")


def late_snapshots(history: DataFrame, incoming: DataFrame, keys: list[str], ts_col: str) -> DataFrame:
    """The rows of ``incoming`` that :func:`scd2_merge` leaves out because
    they come before the key's open version without starting any version:
    data that arrived late, to be kept aside and placed by a rebuild.  A
    snapshot inside a closed version that changes nothing is among them."""
    h = history.select(*[F.col(k).alias(f"__h_{k}") for k in keys], "eff_from", "is_current")
    same = [incoming[k].eqNullSafe(h[f"__h_{k}"]) for k in keys]
    after = incoming.join(h.filter("is_current"), [*same, incoming[ts_col] < h["eff_from"]], "left_semi")
    return after.join(h, [*[after[k].eqNullSafe(h[f"__h_{k}"]) for k in keys], after[ts_col] == h["eff_from"]], "left_anti")


def scd2_from_changes(snapshots: DataFrame, keys: list[str], ts_col: str, tracked: list[str],
                      key_id: str | None = None, id_stride: int = 1_000_000,
                      reason_first: str = "new", reason_change: str = "changed") -> DataFrame:
    """Build SCD-2 versions from a stream of attribute snapshots.

    A new version starts where the tracked attributes differ from the key's
    previous snapshot (unchanged snapshots add nothing).  ``eff_to`` is the
    next version's ``eff_from`` (NULL while current).  ``version`` numbers
    versions per key from 1; ``history_id`` = key * id_stride + version for
    a single numeric key (deterministic, no global row numbering).  All
    per-key sequencing is two-level (see :mod:`operators.sequence`).
    """
    h = snapshots.withColumn("__h", record_hash(tracked))
    order = [ts_col]
    h = prev_value(h, keys, order, "__h", "__prev_h")
    changes = h.filter(F.col("__prev_h").isNull() | (F.col("__prev_h") != F.col("__h")))
    changes = changes.withColumn(
        "change_reason", F.when(F.col("__prev_h").isNull(), F.lit(reason_first)).otherwise(F.lit(reason_change)))
    # Each two-level step reads its input twice; cutting lineage between
    # steps (scratch tables in the shared checkpoint folder) keeps the
    # plan linear and makes a lost executor recompute one step, not all.
    changes = next_value(written(changes), keys, order, ts_col, "eff_to")
    changes = row_number_in_key(written(changes), keys, order, "version")
    out = changes.withColumnRenamed(ts_col, "eff_from").withColumn(
        "is_current", F.col("eff_to").isNull()).drop("__h", "__prev_h")
    if key_id:
        out = out.withColumn("history_id", history_id(key_id, id_stride))
    return out


def scd2_merge(history: DataFrame, incoming: DataFrame, keys: list[str], ts_col: str,
               tracked: list[str], reason_first: str = "new",
               reason_change: str = "changed") -> DataFrame:
    """Incremental SCD-2 (C2-C5): close the open version of every key whose
    tracked attributes changed in ``incoming`` and open the new versions.

    ``history`` has (keys, tracked, eff_from, eff_to, is_current,
    change_reason, version); ``incoming`` has (keys, tracked, ts_col),
    possibly several snapshots per key (unique per key and ts).  Unchanged
    snapshots add nothing, and snapshots at or before the start of a key's
    open version are ignored (already applied, or late), so replaying a batch
    changes nothing.  :func:`late_snapshots` returns the late ones for
    quarantine; :func:`scd2_splice` places them.
    """
    history = history.checkpoint(eager=True)
    incoming = incoming.checkpoint(eager=True)
    cur = history.filter(F.col("is_current"))
    closed = history.filter(~F.col("is_current"))
    start = cur.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("eff_from").alias("__o_from"))
    salted, start, same = spread_hot(incoming, start, keys, [f"__o_{k}" for k in keys])
    incoming = salted.join(start, same, "left").drop("__salt", "__right_salt")
    incoming = incoming.filter(F.col("__o_from").isNull() | (F.col(ts_col) > F.col("__o_from")))
    seed = cur.select(*keys, *tracked, F.col("eff_from").alias(ts_col), F.lit(0).alias("__src"),
                      "version", "change_reason")
    inc = incoming.select(*keys, *tracked, ts_col, F.lit(1).alias("__src"),
                          F.lit(None).cast("bigint").alias("version"),
                          F.lit(None).cast("string").alias("change_reason"))
    order = [ts_col, "__src"]  # the stored version sorts first on equal ts
    u = seed.unionByName(inc).withColumn("__h", record_hash(tracked))
    u = prev_value(u, keys, order, "__h", "__prev_h")
    kept = u.filter((F.col("__src") == 0) | F.col("__prev_h").isNull()
                    | (F.col("__prev_h") != F.col("__h")))
    kept = next_value(kept.checkpoint(eager=True), keys, order, ts_col, "eff_to").checkpoint(eager=True)
    new = row_number_in_key(kept.filter(F.col("__src") == 1), keys, order, "__pos")
    base = cur.select(*[F.col(k).alias(f"__b_{k}") for k in keys], F.col("version").alias("__base"))
    new = new.join(base, [new[k].eqNullSafe(base[f"__b_{k}"]) for k in keys], "left")
    new = new.withColumn("version", F.coalesce(F.col("__base"), F.lit(0)) + F.col("__pos")).withColumn(
        "change_reason", F.when(F.col("__prev_h").isNull(), F.lit(reason_first))
        .otherwise(F.lit(reason_change)))
    cols = [*keys, *tracked, F.col(ts_col).alias("eff_from"), "eff_to",
            F.col("eff_to").isNull().alias("is_current"), "change_reason", "version"]
    seeds_out = kept.filter(F.col("__src") == 0).select(*cols)
    return closed.select(seeds_out.columns).unionByName(seeds_out).unionByName(new.select(*cols))


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> tuple[DataFrame, list[Column]]:
    """``right`` with its keys renamed, and the null-safe equality of keys."""
    r = right.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})
    return r, [left[k].eqNullSafe(r[f"{prefix}{k}"]) for k in keys]


def scd2_splice(history: DataFrame, seen: DataFrame, incoming: DataFrame, keys: list[str], ts_col: str,
                tracked: list[str], reason_first: str = "new", reason_change: str = "changed") -> tuple[DataFrame, DataFrame]:
    """SCD-2 with snapshots in any order of arrival: ``(history, seen)`` after
    ``incoming``, equal to :func:`scd2_from_changes` over all snapshots so far.

    Beside the versions the state keeps ``seen`` (keys, ts_col): when each key
    was observed.  A late snapshot that differs from the version it falls into
    closes it there, and the version goes on at the key's next observation
    after it; that time is in no version, as equal snapshots add none.  An
    observation's attributes are those of the version it lies in, so times
    suffice.  Only keys of the batch are worked on; versions of others pass
    through.  Snapshots that were seen before change nothing; of several of
    one key and time in a batch the largest by its attributes counts."""
    history, seen = written(history), written(seen)
    attrs = F.struct(*tracked)
    new = incoming.groupBy(*keys, ts_col).agg(F.max(attrs).alias("__a"))
    old, same = _same_keys(new, seen, keys, "__o_")
    new = written(new.join(old.withColumnRenamed(ts_col, "__o_ts"), [*same, new[ts_col] == F.col("__o_ts")], "left_anti"))
    if new.isEmpty():
        return history, seen.select(*keys, ts_col)
    touched = written(new.select(*[F.col(k).alias(f"__t_{k}") for k in keys]).distinct().withColumn("__hit", F.lit(True)))

    def with_touched(df: DataFrame, how: str) -> DataFrame:
        salted, t, same = spread_hot(df, touched, keys, [f"__t_{k}" for k in keys])
        return salted.join(t, same, how).drop("__salt")

    # one pass tells the versions to work on from those that pass through
    marked = written(with_touched(history, "left").select(*history.columns, "__hit"))
    begun = marked.filter("__hit").select(*keys, F.col("eff_from").alias("__from"), attrs.alias("__a"))
    times = with_touched(seen, "left_semi").select(*keys, ts_col)
    b, same = _same_keys(times, begun, keys, "__b_")
    times = times.join(b, [*same, times[ts_col] == F.col("__from")], "left").select(
        *keys, ts_col, "__a", F.lit(False).alias("__new"))
    line = times.unionByName(new.withColumn("__new", F.lit(True)))
    line = written(line.withColumn("__known", F.when(~F.col("__new"), F.col("__a"))))
    line = last_known(line, keys, [ts_col], {"__version": "__known"})
    line = line.withColumn("__a", F.when(F.col("__new"), F.col("__a")).otherwise(F.col("__version"))).select(*keys, ts_col, "__a")
    line = prev_value(written(line), keys, [ts_col], "__a", "__before")
    starts = written(line.filter(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.col("__a"))))
    starts = written(next_value(starts, keys, [ts_col], ts_col, "eff_to"))
    starts = row_number_in_key(starts, keys, [ts_col], "version")
    made = starts.select(
        *keys, *[F.col(f"__a.{c}").alias(c) for c in tracked], F.col(ts_col).alias("eff_from"), "eff_to",
        F.col("eff_to").isNull().alias("is_current"),
        F.when(F.col("version") == 1, reason_first).otherwise(reason_change).alias("change_reason"), "version")
    return (marked.filter("__hit IS NULL").select(made.columns).unionByName(made),
            seen.select(*keys, ts_col).unionByName(new.select(*keys, ts_col)))
