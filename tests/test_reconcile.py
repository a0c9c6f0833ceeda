"""Clustering depth, hash-tree drill-down, cube lattice, carried versions and
member sketches, each against a plain form."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from tillpoint.operators.joins import as_of_carry, as_of_join
from tillpoint.plans import aggregates as ag
from tillpoint.plans import quality as q
from tillpoint.plans import views as v
from tillpoint.sources import testdata as td
from tillpoint.sources.sinks import clustered


def folder():
    return tempfile.mkdtemp(prefix="tillpoint-quality-")


def plain_depths(ranges):
    return [sum(a <= low <= b for a, b in ranges) for low, _ in ranges]


@pytest.mark.parametrize("key", ["customer_sk", "sale_date", "invoice_ts"])
def test_clustering_depth_is_a_count_of_overlaps(spark, key):
    fact = td.fact_sales(spark, SF_SMALL).select("customer_sk", "sale_date", "invoice_ts", "store_sk")
    for name, laid in (("clustered", clustered(fact, [key], 9)), ("shuffled", fact.repartition(9))):
        path = folder()
        laid.write.mode("overwrite").parquet(path)
        t = spark.read.parquet(path)
        ranges = [(r.low, r.high) for r in q.file_ranges(t, key).collect()]
        d = q.clustering_depth(t, "f", key, buckets=4).first()
        depths = plain_depths(ranges)
        assert (d.files, d.max_depth, d.row_count) == (len(ranges), max(depths), fact.count())
        assert abs(d.avg_depth - sum(depths) / len(depths)) < 1e-9
        assert q.check_clustered(t, "f", key).first().passed == (name == "clustered")


def test_clustering_depth_within_partitions_and_of_nothing(spark):
    path = folder()
    df = spark.range(1000).select((F.col("id") % 2).alias("p"), "id")
    clustered(df, ["p", "id"], 6).write.mode("overwrite").partitionBy("p").parquet(path)
    got = {r.p: r for r in q.clustering_depth(spark.read.parquet(path), "t", "id", ["p"]).collect()}
    assert set(got) == {0, 1} and all(r.max_depth == 1 for r in got.values())
    empty = folder()
    spark.createDataFrame([], "id long").write.mode("overwrite").parquet(empty)
    assert q.clustering_depth(spark.read.parquet(empty), "t", "id").count() == 0


def drill(spark, a, b, buckets=8):
    schema = "part string, k long, v string"
    s, t = (spark.createDataFrame(x, schema) for x in (a, b))
    trees = [q.hash_tree(x, "part", ["k"], buckets) for x in (s, t)]
    found = q.differing_buckets(*trees)
    return found, q.drill_down(s, t, "part", ["k"], found, buckets)


def test_drill_down_finds_what_was_planted(spark):
    base = [(f"p{k % 3}", k, f"v{k}") for k in range(300)] + [("p1", 1000, None), (None, 1001, "n"), ("p0", None, "k")]
    changed = {7: "z", 8: None, 1000: "", 1001: "m"}
    other = [(p, k, changed.get(k, x)) for p, k, x in base if k not in (20, 21)] + [("p0", 5000, "new"), ("p9", 5001, "new")]
    found, got = drill(spark, base, other)
    want = [(k, "changed") for k in changed] + [(20, "missing"), (21, "missing"), (5000, "extra"), (5001, "extra")]
    assert rows(got, "k", "state") == sorted(want)
    assert found.count() <= len(want)
    assert rows(drill(spark, base, list(reversed(base)))[1]) == []
    assert rows(drill(spark, [], [("p", 1, "x")])[1], "k", "state") == [(1, "extra")]


def test_repeated_keys_and_moved_rows(spark):
    a = [("p", 1, "x"), ("p", 1, "x"), ("p", 1, "y"), ("p", 2, "same"), ("q", 3, "m")]
    b = [("p", 1, "x"), ("p", 1, "y"), ("p", 2, "same"), ("r", 3, "m")]
    assert rows(drill(spark, a, b)[1], "k", "part", "state") == [(1, "p", "missing"), (3, "q", "missing"), (3, "r", "extra")]


def test_drill_down_reads_the_differing_buckets_only(spark):
    tables, plain = [], []
    for change in (0, 1):
        path = folder()
        df = spark.range(4000).select(F.lit("p").alias("part"), F.col("id").alias("k"),
                                      F.when(F.col("id") == 77, F.lit(change)).otherwise(F.lit(5)).cast("string").alias("v"))
        q.with_bucket(df, ["k"], 16).write.mode("overwrite").partitionBy("__bucket").parquet(path)
        tables.append(spark.read.parquet(path))
        plain.append(tables[-1].drop("__bucket"))
    found = q.differing_buckets(*[q.hash_tree(t, "part", ["k"], 16) for t in plain]).checkpoint()
    assert found.count() == 1
    got = q.drill_down(*tables, "part", ["k"], found, 16)
    assert rows(got, "k", "state") == [(77, "changed")]
    only = found.first().bucket
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"(__bucket#") and plan.count(f" = {only})") >= 2 and "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_cube_lattice_equals_cube(spark, seed):
    rng = random.Random(seed)
    country = {o: rng.choice(["x", "y", None]) for o in range(40)}
    data = []
    for _ in range(400):
        o = rng.choice([*range(40), None])
        data.append((country.get(o) if seed else rng.choice("xy"), rng.choice((1, 2, None)) if seed == 2 else o and o % 3, rng.choice("abc"), o, rng.randrange(9)))
    df = spark.createDataFrame(data, "c string, m int, p string, o int, v int")
    want = ag.cube_table(df, ["c", "m", "p"], [F.count_distinct("o").alias("orders"), F.sum("v").alias("s")])
    got = ag.cube_lattice(df, ["c", "m", "p"], {"s": F.col("v")}, ("orders", "o"))
    cols = ("dim_level", "cube_key", "c", "m", "p", "orders", "s")
    assert rows(got, *cols) == rows(want, *cols)
    plain = ag.cube_lattice(df, ["c", "p"], {"s": F.col("v")}, level_col="g", key_col=None)
    assert rows(plain, "c", "p", "s", "g") == rows(df.cube("c", "p").agg(F.sum("v").alias("s"), F.grouping_id("c", "p").alias("g")), "c", "p", "s", "g")


def test_cube_of_nothing(spark):
    df = spark.createDataFrame([], "c string, p string, o int, v int")
    assert ag.cube_lattice(df, ["c", "p"], {"s": F.col("v")}, ("orders", "o")).count() == 0


def test_no_expand_over_raw_lines(spark):
    cube = ag.sales_cube(td.fact_sales(spark, SF_SMALL), td.SALES_AS_OF)
    assert "Expand" not in cube._jdf.queryExecution().executedPlan().toString()


def test_carried_versions_equal_the_as_of_join(spark):
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    history = []
    for k in ("hot", "b", "gap", None):
        cuts = sorted(rng.sample(range(400), 12))
        for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], None])):
            if k == "gap" and i % 2:
                continue
            history.append((k, t0 + dt.timedelta(hours=a), None if b is None else t0 + dt.timedelta(hours=b), f"{k}{i}", None if i == 3 else i))
    facts = [(n, rng.choice(["hot"] * 5 + ["b", "gap", "none", None]), t0 + dt.timedelta(hours=rng.randrange(420))) for n in range(600)]
    facts += [(900, "b", None)]
    h = spark.createDataFrame(history, "hk string, eff_from timestamp_ntz, eff_to timestamp_ntz, tag string, n int")
    f = spark.createDataFrame(facts, "id int, k string, ts timestamp_ntz")
    got = as_of_carry(f, h, "k", "hk", "ts", ["tag", "n"])
    assert got.columns == ["id", "k", "ts", "tag", "n"]
    assert rows(got) == rows(as_of_join(f, h, "k", "hk", "ts").select("id", "k", "ts", "tag", "n"))
    assert rows(as_of_carry(f.limit(0), h, "k", "hk", "ts", ["tag"])) == []
    assert as_of_carry(f, h.limit(0), "k", "hk", "ts", ["tag"]).filter("tag IS NULL").count() == len(facts)


def test_sketches_are_within_their_error(spark):
    day = dt.date(2024, 1, 30)
    events = spark.range(200_000).select(
        F.lit("REDEEM").alias("event_type"), F.date_sub(F.lit(day), (F.col("id") % 20).cast("int")).alias("event_date"),
        (F.col("id") % 7).alias("store_sk"), (F.xxhash64("id") % 60_000).cast("string").alias("member_id"), F.lit(2).cast("bigint").alias("points"))
    stores = spark.createDataFrame([(i, "east" if i % 2 else "west") for i in range(6)], "store_sk long, region string")
    s = v.member_sketches(events, stores).checkpoint()
    assert s.count() == 20 * 3  # stores without a region too
    got = {(r.days, r.region): r for r in v.members_from_sketches(s, day, [0, 5, 30]).collect()}
    for n in (0, 5, 30):
        since = events.filter(F.col("event_date") >= F.date_sub(F.lit(day), n)).join(stores, "store_sk", "left")
        for r in since.groupBy("region").agg(F.count_distinct("member_id").alias("n"), F.sum("points").alias("p")).collect():
            g = got[n, r.region]
            assert abs(g.approx_active_members - r.n) <= 0.03 * r.n and g.total_points_redeemed == r.p
