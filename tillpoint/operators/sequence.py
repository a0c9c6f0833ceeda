"""Per-key sequence windows that stay balanced when one key is hot.

``lag``/``lead``/running sums over ``partition by key order by ts`` put all
of a key's rows in one task; a key holding a third of the data becomes a
third of the job in one task.  These helpers split the work in two levels:

1. the window runs inside (key, bucket), where the bucket is a coarse,
   order-compatible function of the ordering column (the day by default);
2. a per-(key, bucket) summary - one row per bucket, so bounded by the
   time span, not by the data - carries values across bucket borders with a
   small window per key, and is joined back on (key, bucket).

The ordering must be total within a key (add tie-breakers to ``order``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__seq_bucket"


def _with_bucket(df: DataFrame, bucket: Column | None, order: list[str]) -> DataFrame:
    b = bucket if bucket is not None else F.to_date(F.col(order[0]))
    return df.withColumn(_B, b)


def _join_summary(df: DataFrame, summ: DataFrame, keys: list[str]) -> DataFrame:
    ren = {k: f"__s_{i}" for i, k in enumerate(keys)}
    s = summ.select(*[F.col(k).alias(v) for k, v in ren.items()], F.col(_B).alias("__s_b"),
                    *[c for c in summ.columns if c not in keys and c != _B])
    cond = [df[_B] == s["__s_b"]] + [df[k].eqNullSafe(s[v]) for k, v in ren.items()]
    return df.join(s, cond, "left").drop("__s_b", *ren.values())


def _struct_order(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def prev_value(df: DataFrame, keys: list[str], order: list[str], col: str, out: str,
               bucket: Column | None = None) -> DataFrame:
    """``out`` = value of ``col`` on the previous row of the same key."""
    d = _with_bucket(df, bucket, order)
    w = Window.partitionBy(*keys, _B).orderBy(*order)
    d = d.withColumn("__local_prev", F.lag(col).over(w)).withColumn(
        "__is_first", F.row_number().over(w) == 1)
    last = d.groupBy(*keys, _B).agg(F.max_by(F.col(col), _struct_order(order)).alias("__blast"))
    wb = Window.partitionBy(*keys).orderBy(_B)
    summ = last.select(*keys, _B, F.lag("__blast").over(wb).alias("__carry"))
    j = _join_summary(d, summ, keys)
    return j.withColumn(out, F.when(F.col("__is_first"), F.col("__carry"))
                        .otherwise(F.col("__local_prev"))).drop(
        "__local_prev", "__is_first", "__carry", _B)


def next_value(df: DataFrame, keys: list[str], order: list[str], col: str, out: str,
               bucket: Column | None = None) -> DataFrame:
    """``out`` = value of ``col`` on the next row of the same key."""
    d = _with_bucket(df, bucket, order)
    w = Window.partitionBy(*keys, _B).orderBy(*order)
    wr = Window.partitionBy(*keys, _B).orderBy(*[F.col(c).desc() for c in order])
    d = d.withColumn("__local_next", F.lead(col).over(w)).withColumn(
        "__is_last", F.row_number().over(wr) == 1)
    first = d.groupBy(*keys, _B).agg(F.min_by(F.col(col), _struct_order(order)).alias("__bfirst"))
    wb = Window.partitionBy(*keys).orderBy(_B)
    summ = first.select(*keys, _B, F.lead("__bfirst").over(wb).alias("__carry"))
    j = _join_summary(d, summ, keys)
    return j.withColumn(out, F.when(F.col("__is_last"), F.col("__carry"))
                        .otherwise(F.col("__local_next"))).drop(
        "__local_next", "__is_last", "__carry", _B)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column | str,
                out: str, bucket: Column | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over the key's rows up to and including
    this one (ROWS frame, in ``order``)."""
    v = F.col(value) if isinstance(value, str) else value
    d = _with_bucket(df, bucket, order).withColumn("__v", v)
    w = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__local", F.sum("__v").over(w))
    tot = d.groupBy(*keys, _B).agg(F.sum("__v").alias("__btot"))
    wb = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    summ = tot.select(*keys, _B, F.sum("__btot").over(wb).alias("__carry"))
    j = _join_summary(d, summ, keys)
    zero = F.lit(0).cast(j.schema["__local"].dataType)
    return j.withColumn(out, F.col("__local") + F.coalesce(F.col("__carry"), zero)).drop(
        "__v", "__local", "__carry", _B)


def row_number_in_key(df: DataFrame, keys: list[str], order: list[str], out: str,
                      bucket: Column | None = None) -> DataFrame:
    """1-based position of the row within its key, in ``order``."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, bucket)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None,
            maxima: dict[str, str] | None = None, bucket: Column | None = None) -> DataFrame:
    """Several running aggregates in one pass: ``sums`` and ``maxima`` map an
    output column to the column it runs over (ROWS frame up to this row; a
    sum counts NULL as 0, a maximum skips it)."""
    d = _with_bucket(df, bucket, order)
    w = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    runs = [(o, F.sum, F.coalesce(F.col(c), F.lit(0))) for o, c in (sums or {}).items()]
    runs += [(o, F.max, F.col(c)) for o, c in (maxima or {}).items()]
    summ = (d.groupBy(*keys, _B).agg(*[fn(c).alias(f"__t_{o}") for o, fn, c in runs])
            .select(*keys, _B, *[fn(f"__t_{o}").over(wb).alias(f"__c_{o}") for o, fn, _ in runs]))
    j = _join_summary(d.withColumns({f"__l_{o}": fn(c).over(w) for o, fn, c in runs}), summ, keys)
    merged = {o: F.greatest(f"__l_{o}", f"__c_{o}") if fn is F.max else F.col(f"__l_{o}") + F.coalesce(f"__c_{o}", F.lit(0)) for o, fn, _ in runs}
    return j.withColumns(merged).drop(_B, *[f"__{x}_{o}" for o, _, _ in runs for x in "lc"])


def last_known(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
               bucket: Column | None = None) -> DataFrame:
    """Each output of ``values`` (output -> column) is the column's last
    non-NULL value on this or an earlier row of the key."""
    d = _with_bucket(df, bucket, order)
    w = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    at = _struct_order(order)
    summ = (d.groupBy(*keys, _B).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"__t_{o}") for o, c in values.items()])
            .select(*keys, _B, *[F.last(f"__t_{o}", ignorenulls=True).over(wb).alias(f"__c_{o}") for o in values]))
    j = _join_summary(d.withColumns({f"__l_{o}": F.last(c, ignorenulls=True).over(w) for o, c in values.items()}), summ, keys)
    return j.withColumns({o: F.coalesce(f"__l_{o}", f"__c_{o}") for o in values}).drop(
        _B, *[f"__{x}_{o}" for o in values for x in "lc"])
