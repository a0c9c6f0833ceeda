"""Operators against plain windows / brute force, with a hot key."""

import datetime as dt
import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from tillpoint.operators import joins, keys, merge, sequence
from tillpoint.plans import facts

T0 = dt.datetime(2024, 1, 1)


def _events(spark, n=600, seed=3):
    random.seed(seed)
    data = []
    for i in range(n):
        key = "hot" if random.random() < 0.4 else random.choice(["a", "b", None])
        ts = T0 + dt.timedelta(minutes=random.randint(0, 60 * 24 * 6))
        data.append((key, ts, i, random.randint(-5, 9), random.choice(["x", "y"])))
    return spark.createDataFrame(data, "k string, ts timestamp_ntz, id int, v int, attr string")


def test_sequence_helpers_match_plain_windows(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    exp = df.select("id", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                    F.row_number().over(w).alias("rn"))
    got = sequence.prev_value(df, ["k"], ["ts", "id"], "v", "p")
    got = sequence.next_value(got, ["k"], ["ts", "id"], "v", "n")
    got = sequence.running_sum(got, ["k"], ["ts", "id"], "v", "s")
    got = sequence.row_number_in_key(got, ["k"], ["ts", "id"], "rn")
    assert rows(got, "id", "p", "n", "s", "rn") == rows(exp, "id", "p", "n", "s", "rn")


def test_interval_left_join_matches_brute_force(spark):
    random.seed(5)
    left = spark.createDataFrame(
        [(random.choice([1, 1, 1, 2, None]), T0 + dt.timedelta(hours=random.randint(0, 200)), i)
         for i in range(150)], "lk bigint, lts timestamp_ntz, lid int")
    right = spark.createDataFrame(
        [(random.choice([1, 2, 3]), T0 + dt.timedelta(hours=random.randint(0, 230), seconds=random.choice([0, 1])), j)
         for j in range(150)], "rk bigint, rts timestamp_ntz, rid int")
    got = joins.interval_left_join(left, right, "lk", "rk", "lts", "rts", 1)
    cond = ((left.lk == right.rk) & (right.rts >= left.lts)
            & (right.rts <= left.lts + F.expr("INTERVAL 1 DAY")))
    exp = left.join(right, cond, "left")
    assert rows(got, "lid", "rid") == rows(exp, "lid", "rid")


def _trailing_brute(left, right, width_s):
    """The plain form: range join, then max / distinct set per left id."""
    cond = ((left.lk == right.rk) & (right.rts >= left.lts - F.expr(f"INTERVAL {width_s} SECONDS"))
            & (right.rts <= left.lts))
    j = left.join(right, cond, "left")
    return j.groupBy("lid").agg(F.max("rv").alias("mx"), F.max(F.when(F.col("rid").isNotNull(), F.struct("rts", "rid"))).alias("last"),
                                F.array_sort(F.collect_set("rc")).alias("codes"))


def test_trailing_agg_matches_brute_force(spark):
    random.seed(11)
    # a hot key, timestamps on block edges (whole hours) and on the range
    # bounds (right rows exactly width before a left row), NULL keys/times
    left = [(random.choice([1, 1, 1, 2, None]), T0 + dt.timedelta(hours=random.randint(0, 120),
                                                                 minutes=random.choice([0, 0, 30])), i)
            for i in range(160)]
    left.append((1, None, 999))
    right = [(random.choice([1, 1, 2, 3, None]),
              T0 + dt.timedelta(hours=random.randint(0, 140), minutes=random.choice([0, 30, 59])),
              random.choice([None, 1, 5, 9]), random.choice(["a", "b", "c", None]), j)
             for j in range(300)]
    right += [(lk, lts - dt.timedelta(days=1), 42, "edge", 1000 + i)
              for i, (lk, lts, _) in enumerate(left[:20]) if lts is not None]
    right += [(lk, lts, 7, "same", 2000 + i) for i, (lk, lts, _) in enumerate(left[20:40]) if lts is not None]
    L = spark.createDataFrame(left, "lk bigint, lts timestamp_ntz, lid int")
    R = spark.createDataFrame(right, "rk bigint, rts timestamp_ntz, rv int, rc string, rid int")
    for width, blk in [(86400, 3600), (86400, 7200), (5400, 3600), (1800, 3600)]:
        got = joins.trailing_agg(L, R, ["lid"], "lk", "rk", "lts", "rts", width,
                                 maxes={"mx": F.col("rv"), "last": F.struct("rts", "rid")},
                                 sets={"codes": F.col("rc")}, block_seconds=blk)
        assert got.columns == ["lk", "lts", "lid", "mx", "last", "codes"]
        exp = _trailing_brute(L, R, width)
        assert rows(got, "lid", "mx", "last", "codes") == rows(exp, "lid", "mx", "last", "codes"), (width, blk)


def test_upsert_last_writer_delete_and_replay(spark):
    cur = spark.createDataFrame([(1, "old", 10), (2, "keep", 50), (3, "gone", 5)], "id int, val string, ts int")
    ch = spark.createDataFrame(
        [(1, "new", 20, "U"), (1, "newer", 30, "U"), (2, "stale", 40, "U"),
         (3, "x", 6, "D"), (4, "ins", 1, "I"), (4, "del", 2, "D"), (5, "ghost", 1, "D"), (6, "tie", 7, "U")],
        "id int, val string, ts int, op string")
    cur = cur.unionByName(spark.createDataFrame([(6, "was", 7)], "id int, val string, ts int"))
    out = merge.upsert(cur, ch, ["id"], "ts", op_col="op")
    expected = [(1, "newer", 30), (2, "keep", 50), (6, "tie", 7)]
    assert rows(out) == expected
    again = merge.upsert(out, ch, ["id"], "ts", op_col="op")
    assert rows(again) == expected


def test_scd2_merge_equals_one_shot_and_skips_unchanged(spark):
    df = _events(spark, 300, seed=11).filter(F.col("k").isNotNull())
    one = merge.scd2_from_changes(df, ["k"], "ts", ["attr"]).select(
        "k", "attr", "eff_from", "eff_to", "is_current", "change_reason", "version")
    split = T0 + dt.timedelta(days=3)
    first = merge.scd2_from_changes(df.filter(F.col("ts") < split), ["k"], "ts", ["attr"]).select(
        "k", "attr", "eff_from", "eff_to", "is_current", "change_reason", "version")
    two = merge.scd2_merge(first, df.filter(F.col("ts") >= split), ["k"], "ts", ["attr"])
    assert rows(two) == rows(one)
    # replaying the second batch adds nothing
    three = merge.scd2_merge(two, df.filter(F.col("ts") >= split), ["k"], "ts", ["attr"])
    assert rows(three) == rows(two)


def test_scd2_two_changes_one_day(spark):
    d = [("k", T0, "a"), ("k", T0 + dt.timedelta(hours=1), "a"), ("k", T0 + dt.timedelta(hours=2), "b"),
         ("k", T0 + dt.timedelta(hours=3), "c")]
    df = spark.createDataFrame(d, "k string, ts timestamp_ntz, attr string")
    out = merge.scd2_from_changes(df, ["k"], "ts", ["attr"]).orderBy("eff_from").collect()
    assert [(r.attr, r.version, r.is_current) for r in out] == [("a", 1, False), ("b", 2, False), ("c", 3, True)]
    assert out[0].eff_to == T0 + dt.timedelta(hours=2)


def test_as_of_join_picks_valid_version(spark):
    hist = spark.createDataFrame(
        [(1, T0, T0 + dt.timedelta(days=40), "v1"), (1, T0 + dt.timedelta(days=40), None, "v2")],
        "hk int, eff_from timestamp_ntz, eff_to timestamp_ntz, tag string")
    fact = spark.createDataFrame(
        [(1, T0 - dt.timedelta(days=1)), (1, T0 + dt.timedelta(days=39)), (1, T0 + dt.timedelta(days=40)),
         (1, T0 + dt.timedelta(days=90)), (2, T0)], "fk int, ts timestamp_ntz")
    out = rows(joins.as_of_join(fact, hist, "fk", "hk", "ts"), "fk", "ts", "tag")
    assert [r[2] for r in out] == [None, "v1", "v2", "v2", None][:0] or sorted(
        [r[2] for r in out], key=lambda x: (x is not None, x)) == [None, None, "v1", "v2", "v2"]


def test_lookup_join_splits_hot_keys_exactly(spark):
    from tillpoint.operators import keys
    random.seed(17)
    fact = spark.createDataFrame(
        [(i, 7 if i % 3 == 0 else random.choice([1, 2, 3, 4, 5, 99, None])) for i in range(900)],
        "fid int, fk bigint")
    dim = spark.createDataFrame([(k, f"name{k}") for k in [1, 2, 3, 4, 5, 7]], "dk bigint, name string")
    assert keys.hot_keys(fact, "fk", 0.2) == [7]
    for how in ["left", "inner"]:
        got = keys.lookup_join(fact, dim, "fk", "dk", how, share=0.2)
        exp = fact.join(dim, fact.fk == dim.dk, how)
        assert rows(got, "fid", "fk", "dk", "name") == rows(exp, "fid", "fk", "dk", "name")


def test_lookup_join_spreads_hot_and_null_keys(spark):
    from tillpoint.operators import keys
    fact = spark.createDataFrame([(i, None if i % 3 == 0 else 7 if i % 3 == 1 else i, {"k": "v"}) for i in range(3000)],
                                 "fid int, fk bigint, tags map<string,string>")
    dim = spark.createDataFrame([(k, f"name{k}") for k in range(3000)], "dk bigint, name string")
    got = keys.lookup_join(fact, dim, "fk", "dk", salts=8)
    assert got.columns == ["fid", "fk", "tags", "dk", "name"] and got.count() == 3000
    assert got.filter("name IS NULL").count() == 1000 and got.filter("name = 'name7'").count() == 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = keys.lookup_join(fact, dim, "fk", "dk", salts=64).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 3 * 3000 / 8
    with pytest.raises(ValueError):
        keys.lookup_join(fact, dim, "fk", "dk", "full")


def test_hot_keys_of_nothing(spark):
    from tillpoint.operators import keys
    empty = spark.createDataFrame([], "k long")
    assert keys.hot_keys(empty, "k") == [] and keys.lookup_join(empty, empty.withColumnRenamed("k", "d"), "k", "d").count() == 0


def test_upsert_ties_do_not_depend_on_the_order_of_rows(spark):
    changes = [(1, 5, "a", "U"), (1, 5, "b", "D"), (1, 5, "b", "U"), (2, 5, "x", "D"), (2, 4, "z", "U")]
    empty = spark.createDataFrame([], "k int, t int, v string")
    for seed in range(4):
        random.Random(seed).shuffle(changes)
        df = spark.createDataFrame(changes, "k int, t int, v string, op string").repartition(seed + 1)
        assert rows(merge.upsert(empty, df, ["k"], "t", op_col="op")) == [(1, 5, "b")]


def counted(spark, df):
    """``df`` and how often one of its rows was computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(look, df.schema), seen


def test_hot_keys_compute_their_input_once(spark):
    rows = [(7 if i % 2 else i, "a" if i % 3 else None) for i in range(300)]
    df, seen = counted(spark, spark.createDataFrame(rows, "k long, s string"))
    assert keys.hot_keys(df, "k", 0.2) == [7] and seen.value == 300
    assert keys.hot_keys_of(df, ["k", "s"], 0.2) == {"k": [7], "s": ["a"]} and seen.value == 600
    assert keys.hot_keys_of(df.filter("k < 0"), ["k", "s"]) == {"k": [], "s": []}


def test_sales_load_computes_the_landing_once_for_both_lookups(spark):
    raw = spark.createDataFrame(
        [(str(i), f"SKU{i % 3}", None, i, "2001-01-02 03:04:05", 1.5, str(i % 2), "UK", "20010102") for i in range(50)],
        "invoice_no string, stock_code string, description string, quantity long, invoice_date string, unit_price double, "
        "customer_id string, country string, date_ts string")
    raw, seen = counted(spark, raw)
    customers = spark.createDataFrame([("1", 11)], "customer_id string, customer_sk long")
    products = spark.createDataFrame([("SKU2", 22)], "stock_code string, product_sk long")
    loaded = facts.fact_sales_load(raw, customers, products)
    assert seen.value == 50
    found = sorted((int(r.invoice_no), r.customer_sk, r.product_sk) for r in loaded.collect())
    assert found == [(i, 11 if i % 2 else None, 22 if i % 3 == 2 else None) for i in range(50)]


def test_sale_lines_are_joined_to_orders_without_a_sort(spark):
    from tillpoint.sources import testdata as td
    text = td.fact_sales(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "Sort [l_orderkey" not in text
