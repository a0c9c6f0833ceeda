"""Typed writes, partition columns, clustering, and snapshot swaps
for merged state.

* P1 ``write_partitioned`` - overwrite only the partitions present in the
  data (dynamic partition overwrite), so a rerun of one day is idempotent.
* P2 ``with_partition_column`` - synthetic partition columns (day, month,
  year, hour text) derived before the write.
* P3 ``with_ingest_date`` - ingestion-day partition next to the event's own
  date string; late rows keep their event date and land in today's folder.
* P4 ``clustered`` - range partition + sort within partitions on up to two
  keys (min/max statistics then skip row groups for key filters).
* P5 ``typed`` - cast a DataFrame to a declared StructType (try_cast).
* ``write_snapshot`` / ``read_current`` - merged state (C1, K1-K4) is
  written as a new snapshot folder; readers take the latest complete one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# P5 -------------------------------------------------------------------------
def typed(df: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Select and cast the declared columns (missing ones as typed NULLs)."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            c = c.cast(f.dataType) if strict else c.try_cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# P2 / P3 --------------------------------------------------------------------
def partition_expr(source: str, grain: str) -> Column:
    """grain: 'day' -> DATE, 'month' -> first of month, 'year' -> 1 January,
    'hour' -> 'yyyyMMdd_HH' text, 'ymd' -> make_date(year, month, day)
    from three columns named in ``source`` as 'y,m,d'."""
    if grain == "day":
        return F.to_date(F.col(source))
    if grain == "month":
        return F.trunc(F.col(source).cast("date"), "month")
    if grain == "year":
        return F.trunc(F.col(source).cast("date"), "year")
    if grain == "hour":
        return F.date_format(F.col(source), "yyyyMMdd_HH")
    if grain == "ymd":
        y, m, d = source.split(",")
        return F.make_date(F.col(y).cast("int"), F.col(m).cast("int"), F.col(d).cast("int"))
    raise ValueError(grain)


def with_partition_column(df: DataFrame, name: str, source: str, grain: str) -> DataFrame:
    return df.withColumn(name, partition_expr(source, grain))


def with_ingest_date(df: DataFrame, ingest_date: dt.date | None = None,
                     name: str = "_ingest_date") -> DataFrame:
    d = F.lit(ingest_date) if ingest_date else F.current_date()
    return df.withColumn(name, d)


# P4 -------------------------------------------------------------------------
def clustered(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    r = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return r.sortWithinPartitions(*keys)


# P1 -------------------------------------------------------------------------
def write_partitioned(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet",
                      mode: str = "overwrite") -> None:
    """Dynamic partition overwrite: only the partitions present in ``df``
    are replaced; rerunning a day rewrites that day and nothing else."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def drop_partitions(spark: SparkSession, path: str, names: list[str]) -> None:
    """Remove partition folders that hold no rows any more."""
    for name in names:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            fs.delete(p, True)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int,
                   partition_by: list[str] | None = None) -> None:
    """Bucketed, sorted table for joins that repeat on ``keys`` (the join
    then needs no exchange on the bucketed side)."""
    w = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(table)


# Snapshots ------------------------------------------------------------------
SNAPSHOT_COL = "snapshot_id"  # no leading "_": Spark hides such folders


def write_snapshot(df: DataFrame, root: str, snapshot_id: int) -> None:
    """Write the new state under ``root/snapshot_id=<id>``.  Spark's output
    committer moves files into place at job commit, so a snapshot folder is
    complete once visible; older snapshots stay for time travel / rollback."""
    df.write.mode("overwrite").parquet(f"{root}/{SNAPSHOT_COL}={snapshot_id}")


def latest_snapshot(spark: SparkSession, root: str) -> int | None:
    """Id of the newest complete snapshot, by folder: one that holds the
    committer's ``_SUCCESS`` file, empty or not.  None where there is no
    folder or no complete snapshot; any other failure is raised."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    prefix, ids = f"{SNAPSHOT_COL}=", []
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith(prefix) and fs.exists(done):
            ids.append(int(name[len(prefix):]))
    return max(ids, default=None)


def read_snapshot(spark: SparkSession, root: str, snapshot_id: int) -> DataFrame:
    return spark.read.parquet(f"{root}/{SNAPSHOT_COL}={snapshot_id}")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete snapshot."""
    latest = latest_snapshot(spark, root)
    if latest is None:
        raise FileNotFoundError(f"no complete snapshot under {root}")
    return read_snapshot(spark, root, latest)
