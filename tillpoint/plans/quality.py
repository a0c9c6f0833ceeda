"""Q1-Q12: the reference's validation scripts re-aimed as data-quality jobs.

Every check returns rows of (check, object, passed, detail).  Checks over
data are single aggregations (one pass, combined map-side); checks over
metadata (names, schemas) build small DataFrames from the catalog / the
declared StructTypes.
"""

from __future__ import annotations

import datetime as dt
import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequence import running

RESULT = "check string, object string, passed boolean, detail string"


def _result(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT)


# Q1 -------------------------------------------------------------------------
def check_catalog(spark: SparkSession, expected: list[str], actual: list[str]) -> DataFrame:
    """Expected objects missing from the catalog, and unexpected ones."""
    e = spark.createDataFrame([(x,) for x in expected], "name string")
    a = spark.createDataFrame([(x,) for x in actual], "name string")
    missing = e.join(a, "name", "left_anti").select(
        F.lit("Q1_catalog").alias("check"), "name", F.lit(False), F.lit("missing"))
    extra = a.join(e, "name", "left_anti").select(
        F.lit("Q1_catalog"), "name", F.lit(False), F.lit("unexpected"))
    ok = e.join(a, "name").select(F.lit("Q1_catalog"), "name", F.lit(True), F.lit("present"))
    return missing.union(extra).union(ok).toDF("check", "object", "passed", "detail")


# Q2 -------------------------------------------------------------------------
def flatten_schema(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) for every field, recursing into structs, arrays of
    structs and maps."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out.append((path, f.dataType.simpleString()))
        dt = f.dataType
        while isinstance(dt, (T.ArrayType, T.MapType)):
            dt = dt.elementType if isinstance(dt, T.ArrayType) else dt.valueType
        if isinstance(dt, T.StructType):
            out.extend(flatten_schema(dt, path + "."))
    return out


def check_schema(spark: SparkSession, obj: str, expected: T.StructType, actual: T.StructType) -> DataFrame:
    e = spark.createDataFrame(flatten_schema(expected), "path string, expected string")
    a = spark.createDataFrame(flatten_schema(actual), "path string, actual string")
    j = e.join(a, "path", "full_outer")
    passed = F.col("expected").eqNullSafe(F.col("actual"))
    return j.select(F.lit("Q2_schema").alias("check"), F.concat_ws(".", F.lit(obj), "path").alias("object"),
                    passed.alias("passed"),
                    F.concat(F.lit("expected="), F.coalesce("expected", F.lit("-")), F.lit(" actual="),
                             F.coalesce("actual", F.lit("-"))).alias("detail"))


# Q3 -------------------------------------------------------------------------
def check_partition_column(df: DataFrame, obj: str, col: str, expected: Column) -> DataFrame:
    """Every row's partition column equals its recomputed value."""
    bad = F.sum(F.when(F.col(col).eqNullSafe(expected), 0).otherwise(1))
    return df.agg(bad.alias("n"), F.count(F.lit(1)).alias("rows")).select(
        F.lit("Q3_partition").alias("check"), F.lit(f"{obj}.{col}").alias("object"),
        (F.col("n") == 0).alias("passed"),
        F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("rows").cast("string"),
                 F.lit(" rows differ")).alias("detail"))


def file_ranges(df: DataFrame, key: str, within: list[str] | None = None) -> DataFrame:
    """A row per file of a table read from files: smallest and largest key
    (NULLs apart) and rows."""
    return df.groupBy(*(within or []), F.input_file_name().alias("file")).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows"))


def clustering_depth(df: DataFrame, obj: str, key: str, within: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """Q3 for clustering: per table (or partition ``within`` it), how many
    files a lookup of one key has to open.  Files are intervals of keys; a
    sweep over their ends counts the intervals open at each file's start, as a
    running sum.  ``avg_depth`` near 1 is a clustered table, near the number of
    files one whose files all span all keys.  The sweep is over one row per
    file end, bucketed by key; ``key`` is a number, date or time."""
    within = within or []
    files = file_ranges(df, key, within).filter(F.col("low").isNotNull())
    kind = df.schema[key].dataType

    def number(c: str) -> Column:
        if isinstance(kind, T.DateType):
            return F.datediff(F.col(c), F.lit(dt.date(1970, 1, 1))).cast("double")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
        return F.col(c).cast("double")

    files = files.select(*within, "file", "rows", number("low").alias("low"), number("high").alias("high")).checkpoint()
    span = files.agg(F.min("low"), F.max("high")).first()
    low, width = span[0] or 0.0, ((span[1] or 0.0) - (span[0] or 0.0)) / buckets or 1.0
    ends = (files.select(*within, "rows", F.col("low").alias("at"), F.lit(0).alias("side"))
            .unionByName(files.select(*within, F.lit(0).cast("bigint").alias("rows"), F.col("high").alias("at"), F.lit(1).alias("side")))
            .groupBy(*within, "at", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
            .withColumn("step", F.when(F.col("side") == 0, F.col("n")).otherwise(-F.col("n"))))
    swept = running(ends, within, ["at", "side"], sums={"depth": "step"}, bucket=F.floor((F.col("at") - low) / width))
    return swept.filter("side = 0").groupBy(*within).agg(
        F.sum("n").alias("files"), F.sum("rows").alias("row_count"), (F.sum(F.col("depth") * F.col("n")) / F.sum("n")).alias("avg_depth"),
        F.max("depth").alias("max_depth")).filter("files IS NOT NULL").select(
        F.lit(f"{obj}({key})").alias("object"), *within, "files", "row_count", "avg_depth", "max_depth")


def check_clustered(df: DataFrame, obj: str, key: str, within: list[str] | None = None, limit: float = 2.0) -> DataFrame:
    """Passed where a key lies in at most ``limit`` files on average (two
    neighbours share a key that ends one and begins the next)."""
    d = clustering_depth(df, obj, key, within)
    detail = F.concat(F.lit("files="), F.col("files").cast("string"), F.lit(" avg_depth="), F.round("avg_depth", 2).cast("string"),
                      F.lit(" max_depth="), F.col("max_depth").cast("string"))
    return d.select(F.lit("Q3_clustering").alias("check"), "object", *(within or []), (F.col("avg_depth") <= limit).alias("passed"),
                    detail.alias("detail"), "row_count")


# Q4 -------------------------------------------------------------------------
def check_unique(df: DataFrame, obj: str, keys: list[str]) -> DataFrame:
    """Key uniqueness (storage does not enforce it): duplicated keys and the
    rows they cover; NULL keys count as one key."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return g.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("c"), F.lit(0)).alias("r")).select(
        F.lit("Q4_unique").alias("check"), F.lit(f"{obj}({','.join(keys)})").alias("object"),
        (F.col("k") == 0).alias("passed"),
        F.concat(F.col("k").cast("string"), F.lit(" duplicated keys, "), F.col("r").cast("string"),
                 F.lit(" rows")).alias("detail"))


# Q5 / Q6 --------------------------------------------------------------------
def check_columns_equal(source: DataFrame, target: DataFrame, obj: str, key: str,
                        cols: list[str], check: str = "Q5_fidelity",
                        target_expr: dict[str, Column] | None = None) -> DataFrame:
    """Source vs target value by value after a key join (NULL-safe).
    ``target_expr`` maps a column to the expected source-side expression
    (e.g. the declared rounding for Q6)."""
    s = source.select(key, *[(target_expr or {}).get(c, F.col(c)).alias(f"__s_{c}") for c in cols])
    t = target.select(key, *[F.col(c).alias(f"__t_{c}") for c in cols])
    j = s.join(t, key, "full_outer")
    parts = [F.sum(F.when(F.col(f"__s_{c}").eqNullSafe(F.col(f"__t_{c}")), 0).otherwise(1)).alias(c) for c in cols]
    agg = j.agg(*parts)
    rows = [agg.select(F.lit(check).alias("check"), F.lit(f"{obj}.{c}").alias("object"),
                       (F.col(c) == 0).alias("passed"),
                       F.concat(F.col(c).cast("string"), F.lit(" values differ")).alias("detail")) for c in cols]
    return reduce(DataFrame.union, rows)


# Q7 / Q10 -------------------------------------------------------------------
def null_empty_profile(df: DataFrame, obj: str) -> DataFrame:
    """NULL and '' counts per column in one pass (empty only for strings)."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        aggs.append(F.sum(F.when(c.isNull(), 1).otherwise(0)).alias(f"n__{f.name}"))
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.sum(F.when(c == "", 1).otherwise(0)).alias(f"e__{f.name}"))
    a = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    cols = []
    for f in df.schema.fields:
        e = F.col(f"e__{f.name}") if isinstance(f.dataType, T.StringType) else F.lit(0)
        cols.append(F.struct(F.lit(f.name).alias("column"), F.col(f"n__{f.name}").alias("nulls"),
                             e.cast("bigint").alias("empties")))
    return a.select("__rows", F.explode(F.array(*cols)).alias("p")).select(
        F.lit(obj).alias("object"), F.col("p.column").alias("column"), F.col("__rows").alias("row_count"),
        F.col("p.nulls").cast("bigint").alias("nulls"), F.col("p.empties").alias("empties"))


def check_null_empty_preserved(source: DataFrame, target: DataFrame, obj: str) -> DataFrame:
    """Q7: NULL and '' counts equal between source and target per column."""
    s = null_empty_profile(source, obj).select("column", F.col("nulls").alias("sn"), F.col("empties").alias("se"))
    t = null_empty_profile(target, obj).select("column", F.col("nulls").alias("tn"), F.col("empties").alias("te"))
    j = s.join(t, "column", "full_outer")
    return j.select(F.lit("Q7_null_vs_empty").alias("check"), F.concat_ws(".", F.lit(obj), "column").alias("object"),
                    (F.col("sn").eqNullSafe(F.col("tn")) & F.col("se").eqNullSafe(F.col("te"))).alias("passed"),
                    F.concat_ws(" ", F.lit("nulls"), F.col("sn").cast("string"), F.col("tn").cast("string"),
                                F.lit("empties"), F.col("se").cast("string"), F.col("te").cast("string"))
                    .alias("detail"))


# Q8 -------------------------------------------------------------------------
def float_classes(df: DataFrame, obj: str, cols: list[str]) -> DataFrame:
    """Counts of NaN, +Inf, -Inf, -0.0 and NULL per DOUBLE column (NaN is
    tested with isnan: NaN = NaN is true in Spark)."""
    outs = []
    for c in cols:
        x = F.col(c)
        outs.append(df.agg(
            F.sum(F.when(F.isnan(x), 1).otherwise(0)).alias("nan"),
            F.sum(F.when(x == F.lit(float("inf")), 1).otherwise(0)).alias("pos_inf"),
            F.sum(F.when(x == F.lit(float("-inf")), 1).otherwise(0)).alias("neg_inf"),
            F.sum(F.when(x.cast("string") == "-0.0", 1).otherwise(0)).alias("neg_zero"),
            F.sum(F.when(x.isNull(), 1).otherwise(0)).alias("nulls"),
            F.count(F.lit(1)).alias("row_count")).select(F.lit(obj).alias("object"), F.lit(c).alias("column"), "*"))
    return reduce(DataFrame.unionByName, outs)


# Q9 -------------------------------------------------------------------------
def reconcile(source: DataFrame, target: DataFrame, obj: str, partition_col: str) -> DataFrame:
    """Per partition: row count and an order-free content hash (sum of row
    hashes), source vs target; a full outer join shows partitions missing
    on either side."""
    cols = sorted(c for c in source.columns)

    def summary(df: DataFrame, p: str) -> DataFrame:
        h = F.xxhash64(*[F.col(c) for c in cols]).cast("decimal(38,0)")
        return df.groupBy(partition_col).agg(F.count(F.lit(1)).alias(f"{p}n"), F.sum(h).alias(f"{p}h"))

    j = summary(source, "s").join(summary(target.select(*cols), "t"), partition_col, "full_outer")
    ok = F.col("sn").eqNullSafe(F.col("tn")) & F.col("sh").eqNullSafe(F.col("th"))
    return j.select(F.lit("Q9_reconcile").alias("check"),
                    F.concat_ws("=", F.lit(f"{obj}.{partition_col}"), F.col(partition_col).cast("string")).alias("object"),
                    ok.alias("passed"),
                    F.concat(F.lit("rows="), F.coalesce(F.col("sn"), F.lit(0)).cast("string"), F.lit("/"),
                             F.coalesce(F.col("tn"), F.lit(0)).cast("string")).alias("detail"))


def hash_tree(df: DataFrame, partition_col: str, key: list[str], buckets: int) -> DataFrame:
    """The lower level of a table's hash tree: rows and an order-free hash per
    (partition, bucket of the key); :func:`partition_level` sums it up."""
    cols = sorted(df.columns)
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols]).cast("decimal(38,0)")
    return df.groupBy(F.col(partition_col).alias("part"), hash_bucket(key, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(row).alias("h"))


def hash_bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def partition_level(tree: DataFrame) -> DataFrame:
    return tree.groupBy("part").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))


def _differing(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    x = a.select(*by, F.col("n").alias("__an"), F.col("h").alias("__ah"))
    y = b.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("n").alias("__bn"), F.col("h").alias("__bh"))
    j = x.join(y, [x[c].eqNullSafe(y[f"__{c}"]) for c in by], "full_outer")
    same = F.col("__an").eqNullSafe(F.col("__bn")) & F.col("__ah").eqNullSafe(F.col("__bh"))
    return j.filter(~same).select(*[F.coalesce(c, f"__{c}").alias(c) for c in by])


def differing_buckets(source_tree: DataFrame, target_tree: DataFrame) -> DataFrame:
    """(part, bucket) that differ, looked for below differing partitions only."""
    parts = _differing(partition_level(source_tree), partition_level(target_tree), ["part"]).withColumnRenamed("part", "__p")

    def below(t: DataFrame) -> DataFrame:
        return t.join(parts, t["part"].eqNullSafe(parts["__p"]), "left_semi")

    return _differing(below(source_tree), below(target_tree), ["part", "bucket"])


def drill_down(source: DataFrame, target: DataFrame, partition_col: str, key: list[str], differing: DataFrame,
               buckets: int) -> DataFrame:
    """The rows that differ, from the buckets of ``differing`` alone: ``key``
    columns, partition and ``state`` ('missing' or 'extra' in the target,
    'changed').  A table stored with its bucket as the partition column
    ``__bucket`` (:func:`with_bucket`) is read in those folders only.  Of rows
    of one key and partition, those equal on both sides do not count."""
    cols = sorted(c for c in source.columns if c != "__bucket")
    d = differing.select(F.col("part").alias("__dp"), F.col("bucket").alias("__db"))
    numbers = [r[0] for r in differing.select("bucket").distinct().collect()]  # at most ``buckets``; they prune folders

    def rows(df: DataFrame, side: int) -> DataFrame:
        b = df if "__bucket" in df.columns else with_bucket(df, key, buckets)
        b = b.filter(F.col("__bucket").isin(numbers))
        some = b.join(F.broadcast(d) if few else d, F.col(partition_col).eqNullSafe(F.col("__dp")) & (F.col("__bucket") == F.col("__db")), "left_semi")
        whole = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols])
        return some.select(*key, F.col(partition_col).alias("__part"), whole.alias("__row"), F.lit(side).alias("__side"))

    few = differing.count() <= 100_000  # of numbers and a partition value: a few MB at most, else the join is shuffled
    each = rows(source, 1).unionByName(rows(target, -1)).groupBy(*key, "__part", "__row").agg(F.sum("__side").alias("__more")).filter("__more <> 0")
    g = each.groupBy(*key, "__part").agg(F.max("__more").alias("__hi"), F.min("__more").alias("__lo"))
    state = F.when(F.col("__lo") > 0, "missing").when(F.col("__hi") < 0, "extra").otherwise("changed")
    return g.select(*key, F.col("__part").alias(partition_col), state.alias("state"))


def with_bucket(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn("__bucket", hash_bucket(key, buckets))


# Q11 ------------------------------------------------------------------------
def check_resolves(spark: SparkSession, builders: dict, inputs: dict[str, T.StructType]) -> DataFrame:
    """Analyse every builder on empty inputs with the declared schemas
    (catches a view that names a missing column, like the reference's
    D1, without reading any data)."""
    rows = []
    empties = {k: spark.createDataFrame([], s) for k, s in inputs.items()}
    # an expected analysis failure is a result row here, not an error log
    ctx_log = logging.getLogger("DataFrameQueryContextLogger")
    level = ctx_log.level
    ctx_log.setLevel(logging.CRITICAL)
    try:
        for name, (fn, args) in builders.items():
            try:
                df = fn(*[empties[a] if isinstance(a, str) and a in empties else a for a in args])
                rows.append(("Q11_resolves", name, True, ",".join(df.columns)))
            except Exception as e:  # the check reports, it does not fail
                rows.append(("Q11_resolves", name, False, str(e).splitlines()[0][:300]))
    finally:
        ctx_log.setLevel(level)
    return _result(spark, rows)
