"""RANK / DENSE_RANK without one task per partition key.

``rank() over (partition by P order by v desc)`` puts every row of a key in
one task, and a global ranking (empty P) puts *all* rows in one task.  Here
the order value is cut into value ranges from approximate quantiles (a
handful of numbers on the driver), the window runs per (P, bucket), and
each row adds the number of rows (RANK) or distinct values (DENSE_RANK) of
its key that sort in earlier buckets.  Equal values always land in the same
bucket, so ties are ranked exactly as the plain window ranks them.  Results
are exact; only the balance depends on the quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__rank_bucket"


def default_buckets(df: DataFrame, minimum: int = 16) -> int:
    """As many value buckets as the session has shuffle partitions, so the
    ranking windows spread over the whole cluster (thousands at 100 TB)."""
    try:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        n = minimum
    return max(minimum, n)


def quantile_cuts(df: DataFrame, order_col: str, n_buckets: int | None = None,
                  rel_error: float | None = None) -> list[float]:
    """n_buckets - 1 approximate quantiles of ``order_col`` (bounded list;
    default bucket count from :func:`default_buckets`)."""
    n_buckets = n_buckets or default_buckets(df)
    if n_buckets <= 1:
        return []
    rel_error = rel_error if rel_error is not None else min(0.01, 0.25 / n_buckets)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    return sorted(set(df.approxQuantile(order_col, probs, rel_error)))


def with_value_bucket(df: DataFrame, order_col: str, cuts: list[float],
                      descending: bool = True) -> DataFrame:
    """Add the bucket index in sort order, by binary search over the cut
    points on the JVM (ML ``Bucketizer``; cost O(log #cuts) per row, so the
    cut list can grow with the cluster).  NULLs sort last (Spark's default
    for DESC, and ASC NULLS LAST) and get a bucket of their own."""
    from pyspark.ml.feature import Bucketizer

    value = F.col(order_col)
    if not cuts:  # no quantiles (empty or all-NULL input): one bucket
        return df.withColumn(BUCKET, F.when(value.isNull(), F.lit(1)).otherwise(F.lit(0)))
    splits = [float("-inf"), *cuts, float("inf")]
    n = len(splits) - 1
    tmp = df.withColumn("__rank_v", value.cast("double"))
    b = Bucketizer(splits=splits, inputCol="__rank_v", outputCol="__rank_b",
                   handleInvalid="keep").transform(tmp)
    idx = F.col("__rank_b").cast("int")
    if descending:  # bucket 0 holds the largest values
        idx = F.lit(n - 1) - idx
    return b.withColumn(BUCKET, F.when(value.isNull(), F.lit(n)).otherwise(idx)).drop(
        "__rank_v", "__rank_b")


def rank_within_buckets(b: DataFrame, partition_by: list[str], order_col: str, out_col: str,
                        method: str = "rank", descending: bool = True) -> DataFrame:
    """Rank rows of ``b`` (which carries :data:`BUCKET`)."""
    if method not in ("rank", "dense_rank"):
        raise ValueError(method)
    value = F.col(order_col)
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    w = Window.partitionBy(*partition_by, BUCKET).orderBy(order)
    fn = F.rank() if method == "rank" else F.dense_rank()
    local = b.withColumn("__local_rank", fn.over(w))

    # Rows (RANK) or distinct values (DENSE_RANK; all NULLs are one value)
    # per (key, bucket): at most #keys x #buckets rows; then the running sum
    # over the earlier buckets of the same key.
    if method == "rank":
        measure = F.count(F.lit(1))
    else:
        measure = F.count_distinct(value) + F.max(F.when(value.isNull(), 1).otherwise(0))
    counts = b.groupBy(*partition_by, BUCKET).agg(measure.alias("__n"))
    before = Window.partitionBy(*partition_by).orderBy(BUCKET).rowsBetween(
        Window.unboundedPreceding, -1)
    ren = {k: f"__o_{i}" for i, k in enumerate(partition_by)}
    offsets = counts.select(*[F.col(k).alias(v) for k, v in ren.items()],
                            F.col(BUCKET).alias("__o_bucket"),
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    if not partition_by:
        offsets = F.broadcast(offsets)  # one row per bucket: proven bound
    # Partition keys may be NULL (one NULL group, as in the window).
    cond = [local[BUCKET] == offsets["__o_bucket"]]
    cond += [local[k].eqNullSafe(offsets[v]) for k, v in ren.items()]
    joined = local.join(offsets, on=cond, how="inner").drop("__o_bucket", *ren.values())
    return joined.withColumn(out_col, (F.col("__offset") + F.col("__local_rank")).cast("int")).drop(
        "__local_rank", "__offset")


def bucketed_rank(df: DataFrame, partition_by: list[str], order_col: str, out_col: str,
                  method: str = "rank", descending: bool = True, n_buckets: int | None = None,
                  cuts: list[float] | None = None) -> DataFrame:
    """Add ``out_col`` = rank/dense_rank of ``order_col`` within
    ``partition_by`` (may be empty for a global ranking)."""
    if cuts is None:
        cuts = quantile_cuts(df, order_col, n_buckets)
    b = with_value_bucket(df, order_col, cuts, descending)
    return rank_within_buckets(b, partition_by, order_col, out_col, method, descending).drop(BUCKET)
