"""Join operators Spark has no single primitive for.

* :func:`interval_left_join` - left outer equi + time-range join
  (``right.ts BETWEEN left.ts AND left.ts + width``) with a day bucket added
  to the equi key, so a hot key is split by day and no key's full pair set
  is ever built.
* :func:`as_of_join` - point-in-time lookup into an SCD-2 history
  (``eff_from <= ts < eff_to``), bucketed the same way.
* :func:`trailing_agg` - max / distinct-set aggregates over a trailing time
  range of another table without building the range join's pairs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import last_known


def interval_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                       left_ts: str, right_ts: str, width_days: int = 1,
                       lo_days: int | None = None, hi_days: int | None = None) -> DataFrame:
    """Left outer join keeping every left row; a right row matches when keys
    are equal and ``left_ts + lo_days <= right_ts <= left_ts + hi_days``
    (both ends inclusive; default lo = 0, hi = ``width_days``).

    A right row at day r can only meet left rows of days r - hi .. r - lo,
    so it is copied to those ``hi - lo + 1`` day buckets and each left row
    probes only its own day bucket.  A (left, right) pair therefore meets in
    exactly one bucket: no duplicates, a hot key is split by day, and
    unmatched left rows get exactly one NULL-extended row from the outer
    join itself.
    """
    lo = 0 if lo_days is None else lo_days
    hi = width_days if hi_days is None else hi_days
    offsets = F.array(*[F.lit(i) for i in range(lo, hi + 1)])
    r = right.withColumn("__day", F.explode(
        F.transform(offsets, lambda i: F.date_sub(F.to_date(F.col(right_ts)), i))))
    lft = left.withColumn("__lday", F.to_date(F.col(left_ts)))
    lower = F.timestamp_add("DAY", F.lit(lo), lft[left_ts])
    upper = F.timestamp_add("DAY", F.lit(hi), lft[left_ts])
    cond = ((lft[left_key] == r[right_key]) & (lft["__lday"] == r["__day"])
            & (r[right_ts] >= lower) & (r[right_ts] <= upper))
    return lft.join(r, cond, "left").drop("__lday", "__day")


FAR_FUTURE = dt.datetime(9999, 12, 31)


def as_of_join(fact: DataFrame, history: DataFrame, fact_key: str, hist_key: str,
               fact_ts: str, eff_from: str = "eff_from", eff_to: str = "eff_to",
               how: str = "left") -> DataFrame:
    """Attach the history version valid at ``fact_ts``
    (``eff_from <= ts < eff_to``; an open version has NULL ``eff_to``).

    A version is copied to each month it overlaps, and a fact row probes its
    own month, so the equi part of the join is (key, month) and a key with
    many facts is split by month.  Open versions are copied up to the last
    fact month present (one scalar aggregate).
    """
    month = F.trunc(F.col(fact_ts).cast("date"), "month")
    f = fact.withColumn("__fm", month)
    start = F.trunc(F.col(eff_from).cast("date"), "month")
    # open-ended versions reach the latest fact month present
    horizon = fact.select(F.max(F.col(fact_ts)).cast("date").alias("h")).first()["h"]
    horizon = horizon or dt.date.today()
    end = F.trunc(F.coalesce(F.col(eff_to).cast("date"), F.lit(horizon)), "month")
    h = history.withColumn("__hm", F.explode(F.sequence(start, F.greatest(start, end),
                                                        F.expr("INTERVAL 1 MONTH"))))
    cond = ((f[fact_key] == h[hist_key]) & (f["__fm"] == h["__hm"])
            & (h[eff_from] <= f[fact_ts])
            & (h[eff_to].isNull() | (f[fact_ts] < h[eff_to])))
    return f.join(h, cond, how).drop("__fm", "__hm")


def as_of_carry(fact: DataFrame, history: DataFrame, fact_key: str, hist_key: str, fact_ts: str, cols: list[str],
                eff_from: str = "eff_from", eff_to: str = "eff_to") -> DataFrame:
    """Every fact with ``cols`` of the version of its key that holds at
    ``fact_ts`` (eff_from inclusive, eff_to exclusive; NULLs where none does).

    Facts and versions form one line per key in order of time, along which the
    last version is carried, in days with a summary per day (a key's versions
    and facts of a day are what one task orders), so work is linear: versions
    are not copied to the days they span, and a key with many facts is split.
    Versions of a key must not overlap, as SCD-2 versions do not."""
    version = F.struct(F.col(eff_to).alias("to"), *cols)
    names = fact.columns
    f = fact.select(F.col(fact_key).alias("__k"), F.col(fact_ts).alias("__at"), F.lit(1).alias("__kind"), F.struct(*names).alias("__fact"))
    h = history.filter(F.col(hist_key).isNotNull()).select(
        F.col(hist_key).alias("__k"), F.col(eff_from).alias("__at"), F.lit(0).alias("__kind"), version.alias("__version"))
    line = f.withColumn("__version", F.lit(None).cast(h.schema["__version"].dataType)).unionByName(
        h.withColumn("__fact", F.lit(None).cast(f.schema["__fact"].dataType)))
    line = last_known(line, ["__k"], ["__at", "__kind"], {"__v": "__version"}).filter("__kind = 1")
    holds = F.col("__v.to").isNull() | (F.col("__at") < F.col("__v.to"))
    return line.select("__fact.*", *[F.when(holds, F.col(f"__v.{c}")).alias(c) for c in cols])


def trailing_agg(left: DataFrame, right: DataFrame, left_id: list[str], left_key: str, right_key: str,
                 left_ts: str, right_ts: str, width_seconds: int,
                 maxes: dict[str, Column] | None = None, sets: dict[str, Column] | None = None,
                 block_seconds: int = 3600) -> DataFrame:
    """Per distinct ``left_id``: ``max`` and distinct-set aggregates over the
    right rows with an equal key and ``left_ts - width <= right_ts <= left_ts``.

    The pairs of the range join are never built.  Max and set union are
    idempotent, so the range is cut into pieces whose results simply merge:
    time is divided into blocks of ``block_seconds`` (at most the width);
    the blocks lying wholly inside the range come from one pre-aggregated
    row per (key, block), the block holding ``left_ts`` from a running
    aggregate up to ``left_ts``, and the block holding the lower bound from
    a running aggregate down to it.  Each left row meets at most
    width / block + 2 rows, and every sort runs inside one (key, block), so
    a hot key is split by time and the work stays linear in the input.

    ``maxes`` / ``sets`` map an output name to a Column over ``right`` (a
    struct in ``maxes`` gives the payload of the latest row when its first
    field is the time).  Sets come out sorted, empty when nothing matched;
    maxes are NULL then.  Every left row yields exactly one row per
    distinct ``left_id`` with the left columns unchanged.
    """
    maxes, sets = maxes or {}, sets or {}
    width = int(width_seconds) * 1_000_000
    block = min(int(block_seconds) * 1_000_000, width)
    if width <= 0:
        raise ValueError("width_seconds must be positive")

    def blk(us: Column) -> Column:  # floor(us / block) in exact integer arithmetic
        return ((us - F.pmod(us, F.lit(block))) / F.lit(block)).cast("bigint")

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    vals = list(maxes) + list(sets)
    ids = [F.col(c) for c in left_id]
    r = right.select(F.col(right_key).alias("__k"), micros(right_ts).alias("__us"),
                     *[maxes[n].alias(n) for n in maxes], *[sets[n].alias(n) for n in sets]).filter(
        F.col("__k").isNotNull() & F.col("__us").isNotNull()).withColumn("__b", blk(F.col("__us")))
    lft = left.withColumn("__k", F.col(left_key)).withColumn("__us", micros(left_ts)).withColumn(
        "__lo", F.col("__us") - F.lit(width))
    probe = lft.filter(F.col("__k").isNotNull() & F.col("__us").isNotNull())
    id_struct = F.struct(*ids).alias("__id")

    # every (key, block) summarised by one row (combined map-side)
    per_block = r.groupBy("__k", "__b").agg(*[F.max(n).alias(n) for n in maxes],
                                            *[F.collect_set(n).alias(n) for n in sets])
    b_hi, b_lo = blk(F.col("__us")), blk(F.col("__lo"))
    inner = F.when(b_hi - b_lo >= 2, F.sequence(b_lo + 1, b_hi - 1)).otherwise(
        F.array().cast("array<bigint>"))
    full = probe.select(id_struct, "__k", F.explode(inner).alias("__b")).join(per_block, ["__k", "__b"])
    full = full.select("__id", *[F.col(n) for n in maxes], *[F.col(n) for n in sets])

    # the two edge blocks: right rows (kind 0) with the probes of both edges
    # (kind 1 = upper edge at left_ts, kind 2 = lower edge at left_ts - width)
    nul = [F.lit(None).alias(n) for n in vals]
    edges = r.select(F.lit(None).cast(probe.select(id_struct).schema[0].dataType).alias("__id"),
                     "__k", "__b", "__us", F.lit(0).alias("__kind"), *vals).unionByName(
        probe.select(id_struct, "__k", b_hi.alias("__b"), "__us", F.lit(1).alias("__kind"), *nul)).unionByName(
        probe.select(id_struct, "__k", b_lo.alias("__b"), F.col("__lo").alias("__us"), F.lit(2).alias("__kind"),
                     *nul))
    up = Window.partitionBy("__k", "__b").orderBy(F.col("__us").asc(), F.col("__kind").asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("__k", "__b").orderBy(F.col("__us").desc(), F.col("__kind").asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)

    def edge(n: str, agg) -> Column:  # probes carry NULL values, so only right rows count
        return F.when(F.col("__kind") == 1, agg(n).over(up)).otherwise(agg(n).over(down)).alias(n)

    part = edges.select("__id", "__kind", *[edge(n, F.max) for n in maxes],
                        *[edge(n, F.collect_set) for n in sets]).filter(F.col("__kind") > 0).drop("__kind")

    # one row per left id: its own columns plus the merged pieces
    own = lft.select(id_struct, F.struct(*[F.col(c) for c in left.columns]).alias("__self"), *nul)
    pieces = full.select("__id", F.lit(None).cast(own.schema["__self"].dataType).alias("__self"),
                         *vals).unionByName(
        part.select("__id", F.lit(None).cast(own.schema["__self"].dataType).alias("__self"), *vals))
    allrows = own.select("__id", "__self", *[F.col(n).cast(pieces.schema[n].dataType).alias(n) for n in vals]) \
        .unionByName(pieces)
    g = allrows.groupBy("__id").agg(
        F.first("__self", ignorenulls=True).alias("__self"), *[F.max(n).alias(n) for n in maxes],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n) for n in sets])
    return g.select(*[F.col(f"__self.{c}").alias(c) for c in left.columns], *vals)
