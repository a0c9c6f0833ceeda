"""State in hash buckets: what a batch writes, replays, failures, pruning."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillpoint.operators.merge import upsert
from tillpoint.sources import bucketed_state as bs

SCHEMA = "k long, v string, t long"


def root_dir():
    return tempfile.mkdtemp(prefix="tillpoint-state-")


def merge(cur, batch):
    return upsert(cur, batch, ["k"], "t")


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/data/*/*/*.parquet")}


def test_a_batch_writes_the_buckets_of_its_keys(spark):
    root, schema = root_dir(), frame(spark, []).schema
    assert bs.apply_batch(root, schema, ["k"], frame(spark, [(k, "a", 1) for k in range(500)]), 0, merge, buckets=16, keep=1)
    before = files(root)
    batch = frame(spark, [(7, "b", 2), (8, "c", 2), (1000, "n", 1), (9, "old", 0)])
    touched = {r[0] for r in batch.select(bs.bucket_of(["k"], 16)).collect()}
    assert bs.apply_batch(root, schema, ["k"], batch, 1, merge, keep=1)
    m = bs.manifest(spark, root)
    assert {b for b, g in m.places.items() if g == 1} == touched and set(m.places) == set(range(16)) and m.buckets == 16
    after = files(root)
    kept = {f: t for f, t in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert {f: t for f, t in after.items() if "batch=0" in f} == kept  # same files; the replaced ones are pruned
    want = {k: ("a", 1) for k in range(500)} | {7: ("b", 2), 8: ("c", 2), 1000: ("n", 1)}
    assert rows(bs.read_state(spark, root, schema)) == sorted((k, v, t) for k, (v, t) in want.items())


def test_replays_change_nothing(spark):
    root, schema = root_dir(), frame(spark, []).schema
    one, two = frame(spark, [(1, "a", 1), (None, "x", 1)]), frame(spark, [(1, "b", 2)])
    for batch, number, applied in ((one, 0, True), (two, 1, True), (two, 1, False), (one, 0, False)):
        before = files(root)
        assert bs.apply_batch(root, schema, ["k"], batch, number, merge) == applied
        assert applied or files(root) == before
    assert rows(bs.read_state(spark, root, schema)) == [(None, "x", 1), (1, "b", 2)]


def test_a_failed_batch_leaves_the_state_before_and_is_done_again(spark):
    root, schema = root_dir(), frame(spark, []).schema
    bs.apply_batch(root, schema, ["k"], frame(spark, [(1, "a", 1)]), 0, merge)

    def broken(cur, batch):
        return merge(cur, batch).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        bs.apply_batch(root, schema, ["k"], frame(spark, [(1, "b", 2)]), 1, broken)
    assert rows(bs.read_state(spark, root, schema)) == [(1, "a", 1)]
    assert bs.apply_batch(root, schema, ["k"], frame(spark, [(1, "b", 2)]), 1, merge)
    assert rows(bs.read_state(spark, root, schema)) == [(1, "b", 2)]


def test_emptied_buckets_and_empty_batches(spark):
    root, schema = root_dir(), frame(spark, []).schema
    assert rows(bs.read_state(spark, root, schema)) == []
    assert bs.apply_batch(root, schema, ["k"], frame(spark, []), 0, merge, buckets=4)
    assert bs.apply_batch(root, schema, ["k"], frame(spark, [(1, "a", 1)]), 1, merge)
    assert bs.manifest(spark, root).buckets == 4
    assert bs.apply_batch(root, schema, ["k"], frame(spark, [(1, "a", 2)]), 2, lambda c, b: c.filter("false"))
    assert rows(bs.read_state(spark, root, schema)) == [] and bs.manifest(spark, root).places == {}


def test_older_manifests_stay_readable_until_pruned(spark):
    root, schema = root_dir(), frame(spark, []).schema
    for number in range(5):
        bs.apply_batch(root, schema, ["k"], frame(spark, [(1, f"v{number}", number), (number, "x", 0)]), number, merge, buckets=2, keep=2)
    ids = bs._manifest_ids(spark, root)
    assert ids == [3, 4]
    old = bs.read_state(spark, root, schema, bs._load(spark, root, 3))
    assert ("v3" in {r.v for r in old.collect()}) and ("v4" in {r.v for r in bs.read_state(spark, root, schema).collect()})
    named = {(g, b) for i in ids for b, g in bs._load(spark, root, i).places.items()}
    there = {(int(f.split("batch=")[1].split("/")[0]), int(f.split("bucket=")[1].split("/")[0])) for f in files(root)}
    assert there == named
