"""Surrogate keys and lookups on hot keys.

* :func:`dense_index` numbers rows 0..n-1 in a given order without a global
  ``row_number()`` (which runs in one task): a range-partitioned sort, a
  row number inside each sorted partition, and per-partition offsets from
  a count per partition (one row per partition, so bounded by the task
  count, not by the data).
* :func:`lookup_join` joins a fact to a dimension without sending a hot key
  to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dense_index(df: DataFrame, order_cols: list[str], out: str, start: int = 0) -> DataFrame:
    """Add ``out`` = start + position of the row in ``order_cols`` order
    (order must be total for a deterministic result).

    Rows and counts must see the same range partitions, and a range
    repartition evaluated twice may sample and coalesce differently, so the
    partitioned rows are checkpointed once and both read that."""
    s = df.repartitionByRange(*order_cols).withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True)
    w = Window.partitionBy("__pid").orderBy(*order_cols)
    local = s.withColumn("__pos", F.row_number().over(w) - 1)
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__pid").alias("__opid"),
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # one row per partition of the sort: a proven, small bound
    j = local.join(F.broadcast(offsets), local["__pid"] == offsets["__opid"])
    return j.withColumn(out, (F.col("__off") + F.col("__pos") + F.lit(start)).cast("bigint")).drop(
        "__pid", "__pos", "__opid", "__off")


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Non-NULL values of ``key`` holding more than ``share`` of the rows.
    At most 1 / share values can, so the list brought to the driver is
    bounded (100 keys at 1 %) whatever the size of ``df``."""
    return hot_keys_of(df, [key], share)[key]


def hot_keys_of(df: DataFrame, keys: list[str], share: float = 0.01) -> dict[str, list]:
    """:func:`hot_keys` of several columns from one reading of ``df``.  One
    job: the total and the largest counts come from the same grouped count.
    Nothing is filtered above it, as a filter would go below the count on one
    side only, and ``df`` would be computed twice; the NULL counts are passed
    over here."""
    names = [f"__k{i}" for i in range(len(keys))]
    counts = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)]).groupingSets([[n] for n in names], *names).agg(
        F.count(F.lit(1)).alias("__n"), F.grouping_id().cast("int").alias("__set"))
    most = counts.orderBy(F.desc("__n")).limit((int(1 / share) + 1) * len(keys)).select(*names, "__n", "__set")
    # every row is counted once per key
    total = counts.agg((F.sum("__n") / len(keys)).cast("bigint").alias("__n")).select(
        *[F.lit(None).cast(df.schema[k].dataType).alias(n) for k, n in zip(keys, names)], "__n", F.lit(-1).alias("__set"))
    found = most.unionByName(total).collect()
    least = next(r["__n"] or 0 for r in found if r["__set"] < 0) * share
    every = (1 << len(keys)) - 1
    return {k: [r[n] for r in found if r["__set"] == every - (1 << (len(keys) - 1 - i)) and r[n] is not None and r["__n"] > least]
            for i, (k, n) in enumerate(zip(keys, names))}


SALTS = 64


def orderable(t: T.DataType) -> bool:
    """Whether values of a type can be ordered (and hashed): no maps inside."""
    if isinstance(t, T.StructType):
        return all(orderable(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return orderable(t.elementType)
    return not isinstance(t, (T.MapType, T.VariantType))


def lookup_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str = "left",
                share: float = 0.01, salts: int = SALTS, hot: list | None = None) -> DataFrame:
    """``fact`` joined (left or inner) to ``dim`` whose ``dim_key`` is unique
    (key names must differ).  Rows of keys with more than ``share`` of the
    facts (:func:`hot_keys`) and rows without a key are spread over ``salts``
    by a hash of the row, and the few dimension rows of those keys are copied
    to every salt; all else has salt 0.  So it is one join, no key with a
    third of the facts is shuffled into one task, and the fact is read once
    for the counts (the key column alone; not if ``hot`` names the keys) and
    once for the join."""
    if how not in ("left", "inner"):
        raise ValueError(f"a lookup is a left or inner join, not {how}")
    if hot is None:
        hot = hot_keys(fact.select(fact_key), fact_key, share)
    row = F.pmod(F.xxhash64(*[f.name for f in fact.schema.fields if orderable(f.dataType)]), F.lit(salts)).cast("int")
    spread = F.col(fact_key).isNull() | F.col(fact_key).isin(hot) if hot else F.col(fact_key).isNull()
    f = fact.withColumn("__salt", F.when(spread, row).otherwise(0))
    copies = F.when(F.col(dim_key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    d = dim.withColumn("__dim_salt", F.explode(copies))
    return f.join(d, (F.col(fact_key) == F.col(dim_key)) & (F.col("__salt") == F.col("__dim_salt")), how).drop("__salt", "__dim_salt")


def spread_hot(left: DataFrame, right: DataFrame, keys: list[str], right_keys: list[str], share: float = 0.01,
               salts: int = SALTS) -> tuple[DataFrame, DataFrame, Column]:
    """For a left, inner, semi or anti join of ``left`` to ``right`` (one row
    per key) on keys compared null-safely: both sides and the condition, with
    the rows of hot keys spread by ``__salt`` and the right rows of those keys
    copied to every ``__right_salt``.  Key names must differ."""
    if any(left.schema[a].dataType != right.schema[b].dataType for a, b in zip(keys, right_keys)):
        raise TypeError("keys of different types hash differently")
    mark = F.xxhash64(*keys)
    hot = hot_keys(left.select(mark.alias("__mark")), "__mark", share)
    row = F.pmod(F.xxhash64(*[f.name for f in left.schema.fields if orderable(f.dataType)]), F.lit(salts)).cast("int")
    one = F.array(F.lit(0))
    salted = left.withColumn("__salt", F.when(mark.isin(hot), row).otherwise(0) if hot else F.lit(0))
    copies = F.when(F.xxhash64(*right_keys).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(one) if hot else one
    condition = F.col("__salt") == F.col("__right_salt")
    for a, b in zip(keys, right_keys):
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    return salted, right.withColumn("__right_salt", F.explode(copies)), condition
