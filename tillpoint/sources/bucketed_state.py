"""Merged state in hash buckets: a batch rewrites only the buckets that its
keys fall into.

    root/data/batch=<id>/bucket=<b>/*.parquet    what batch <id> wrote
    root/manifests/<id>.json                     bucket -> batch whose files hold it

A reader takes the newest manifest and reads the folders that it names, so it
sees a whole state or the one before.  The manifest is written last and moved
into place, so a batch that failed half way leaves nothing that counts and is
simply done again; a batch id that is not newer than the manifest's is
skipped, so replays change nothing.  :func:`prune` drops folders that no kept
manifest names.  The driver holds bucket numbers, at most ``buckets`` of them,
never rows.  There is one writer at a time (a stream's foreachBatch).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
KEEP = 2


@dataclass
class Manifest:
    batch: int = -1
    buckets: int = 0
    places: dict[int, int] = field(default_factory=dict)  # bucket -> batch


def _path(spark: SparkSession, name: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _manifest_ids(spark: SparkSession, root: str) -> list[int]:
    names = _names(spark, f"{root}/manifests")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _load(spark: SparkSession, root: str, batch: int) -> Manifest:
    text = spark.read.text(f"{root}/manifests/{batch}.json", wholetext=True).first()[0]
    d = json.loads(text)
    return Manifest(d["batch"], d["buckets"], {int(b): g for b, g in d["places"].items()})


def manifest(spark: SparkSession, root: str) -> Manifest:
    """The newest manifest; an empty one where there is none yet."""
    ids = _manifest_ids(spark, root)
    return _load(spark, root, ids[-1]) if ids else Manifest()


def _save(spark: SparkSession, root: str, m: Manifest) -> None:
    tmp, fs = _path(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray(json.dumps({"batch": m.batch, "buckets": m.buckets, "places": m.places}).encode()))
    out.close()
    if not fs.rename(tmp, _path(spark, f"{root}/manifests/{m.batch}.json")[0]):
        raise OSError(f"manifest {m.batch} of {root} could not be put in place")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_state(spark: SparkSession, root: str, schema: T.StructType, m: Manifest | None = None,
               only: set[int] | None = None) -> DataFrame:
    """The state a manifest names (the newest by default); with ``only``, of
    those buckets."""
    m = m or manifest(spark, root)
    paths = [f"{root}/data/batch={g}/bucket={b}" for b, g in sorted(m.places.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def apply_batch(root: str, schema: T.StructType, keys: list[str], batch: DataFrame, batch_id: int,
                merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS, keep: int = KEEP) -> bool:
    """state = merge(state, batch), bucket by bucket; whether it was applied.
    ``merge`` must treat keys apart.  ``buckets`` counts when a state begins;
    later its manifest does."""
    spark = batch.sparkSession
    m = manifest(spark, root)
    if batch_id <= m.batch:
        return False
    n = m.buckets or buckets
    batch = batch.checkpoint()
    touched = {r[0] for r in batch.select(bucket_of(keys, n)).distinct().collect()}  # at most n numbers
    data = f"{root}/data/batch={batch_id}"
    new = merge(read_state(spark, root, schema, m, touched), batch).select(*schema.fieldNames())
    new = new.withColumn("bucket", bucket_of(keys, n)).repartition(F.col("bucket"))
    new.write.mode("overwrite").partitionBy("bucket").parquet(data)
    written = {int(x.removeprefix("bucket=")) for x in _names(spark, data) if x.startswith("bucket=")}
    if not written <= touched:
        raise ValueError(f"merge made keys of other buckets: {sorted(written - touched)[:5]}")
    places = {b: g for b, g in m.places.items() if b not in touched} | {b: batch_id for b in written}
    _save(spark, root, Manifest(batch_id, n, places))
    prune(spark, root, keep)
    return True


def prune(spark: SparkSession, root: str, keep: int = KEEP) -> None:
    """Drop what only manifests older than the last ``keep`` name."""
    ids = _manifest_ids(spark, root)
    kept = [_load(spark, root, i) for i in ids[-keep:]]
    named = {(g, b) for m in kept for b, g in m.places.items()}
    for i in ids[:-keep]:
        p, fs = _path(spark, f"{root}/manifests/{i}.json")
        fs.delete(p, False)
    for batch in _names(spark, f"{root}/data"):
        g = int(batch.removeprefix("batch="))
        if not kept or g > kept[-1].batch:
            continue  # of a batch under way
        inside = [b for b in _names(spark, f"{root}/data/{batch}") if b.startswith("bucket=")]
        gone = [b for b in inside if (g, int(b.removeprefix("bucket="))) not in named]
        for name in [batch] if len(gone) == len(inside) else [f"{batch}/{b}" for b in gone]:
            p, fs = _path(spark, f"{root}/data/{name}")
            fs.delete(p, True)


def bucketed_sink(root: str, schema: T.StructType, keys: list[str], merge, buckets: int = BUCKETS, keep: int = KEEP):
    """foreachBatch sink over :func:`apply_batch`."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        apply_batch(root, schema, keys, batch, batch_id, merge, buckets, keep)
    return sink
