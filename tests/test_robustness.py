"""Input that the fixtures do not contain: many keys, two spellings of an
address, replays, orders of several lines, empty and broken snapshots."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillpoint.operators.keys import dense_index
from tillpoint.plans import aggregates, facts, staging, state
from tillpoint.sources import sinks
from tillpoint.streaming import jobs

ADDRESS = "addr_line1 string, addr_city string, addr_region string, addr_country string, addr_postal string"


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_dense_index_of_many_wide_rows(spark, tmp_path, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        wide = spark.range(100_000).select(F.xxhash64("id").alias("key"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"))
        dense_index(wide, ["key"], "n", start=1).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = spark.read.parquet(str(tmp_path / "out"))
    r = got.agg(F.count("*").alias("n"), F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"),
                F.count_distinct("key").alias("k")).first()
    assert tuple(r) == (100_000, 100_000, 1, 100_000, 100_000)


def test_two_spellings_of_an_address_are_one_geocode(spark):
    addresses = spark.createDataFrame([("1 Main St", "Ulm", "BW", "DE", "89073"), ("1 MAIN st", "ULM", "BW", "DE", "89073"),
                                       (None, "x", "y", "DE", "1"), ("x", None, "y", "DE", "1")], ADDRESS)
    geography = spark.createDataFrame([], "country_iso2 string, postal_code string, city string, latitude double, longitude double")
    got = staging.geocode(addresses, geography, dt.date(2024, 1, 1))
    assert got.count() == 3 and got.select("raw_addr_hash").distinct().count() == 3


def test_replay_of_an_old_cdc_batch_keeps_deletes(spark):
    ts = [dt.datetime(2024, 1, d) for d in (1, 2)]
    cols = "return_id string, invoice_no string, customer_sk long, return_ts timestamp_ntz, refund_amount decimal(10,2), reason_code string, status string"
    one = spark.createDataFrame([("r", "i", 1, ts[0], None, None, "open", "I")], cols + ", op string")
    two = spark.createDataFrame([("r", "i", 1, ts[1], None, None, "open", "D")], cols + ", op string")
    stored = spark.createDataFrame([], cols)
    for batch in (one, two, one, two):
        stored = state.apply_returns_cdc(stored, batch, tombstones=True).checkpoint()
    assert state.visible_ledger(stored).count() == 0 and stored.count() == 1


def test_an_order_is_attributed_with_all_its_lines(spark):
    at = dt.datetime(2024, 1, 2, 12)
    sales = spark.createDataFrame([("i1", 1, at, 10), ("i1", 1, at, 20)], "invoice_no string, customer_sk long, invoice_ts timestamp_ntz, line_total int") \
        .withColumn("line_total", F.col("line_total").cast("decimal(14,2)"))
    touches = spark.createDataFrame([(1, at - dt.timedelta(hours=1), "http://mail.x", 5, "EU")],
                                    "customer_sk long, event_ts timestamp_ntz, referrer string, campaign_sk long, region string")
    got = aggregates.last_touch(sales, touches).collect()
    assert [(r.invoice_no, float(r.line_total)) for r in got] == [("i1", 30.0)]


def test_type1_takes_nulls_and_one_row_per_key(spark):
    schema = "sk long, code string, name string"
    old = spark.createDataFrame([(1, "a", "old"), (2, "b", "kept")], schema)
    new = spark.createDataFrame([("a", None), ("n", "x"), ("n", "y"), (None, "z")], "code string, name string")
    got = facts.type1_dimension(old, new, "code", "sk", ["name"])
    assert rows(got, "sk", "code", "name") == [(1, "a", None), (2, "b", "kept"), (3, "n", "y")]


def test_snapshots_empty_half_written_and_unreadable(spark, tmp_path):
    root = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, root)
    df = spark.range(5)
    sinks.write_snapshot(df, root, 1)
    assert sinks.read_current(spark, root).count() == 5
    sinks.write_snapshot(df.limit(0), root, 2)
    assert sinks.read_current(spark, root).count() == 0
    os.makedirs(f"{root}/{sinks.SNAPSHOT_COL}=3")  # no _SUCCESS: still being written
    assert sinks.latest_snapshot(spark, root) == 2
    with open(f"{root}/{sinks.SNAPSHOT_COL}=3/part-0.parquet", "w") as f:
        f.write("not parquet")
    with open(f"{root}/{sinks.SNAPSHOT_COL}=3/_SUCCESS", "w"):
        pass
    with pytest.raises(Exception, match="(?i)parquet"):
        cur, _ = jobs._current_state(spark, root, df.schema)
        cur.count()
    none, last = jobs._current_state(spark, str(tmp_path / "nothing"), df.schema)
    assert last == -1 and none.count() == 0


def test_ids_beyond_their_slots_fail(spark):
    from tillpoint.operators.merge import history_id
    df = spark.createDataFrame([(7, 12), (8, 1_000_000)], "k long, version long")
    assert df.filter("k = 7").select(history_id("k").alias("h")).first().h == 7_000_012
    with pytest.raises(Exception, match="larger id stride"):
        df.select(history_id("k").alias("h")).collect()


def test_late_snapshots_are_returned(spark):
    from tillpoint.operators.merge import late_snapshots, scd2_from_changes, scd2_merge
    t = [dt.datetime(2024, 1, d) for d in range(1, 10)]
    snaps = lambda x: spark.createDataFrame(x, "k long, a string, ts timestamp_ntz")
    history = scd2_from_changes(snaps([(1, "x", t[2]), (1, "y", t[5]), (2, "z", t[2])]), ["k"], "ts", ["a"])
    history = history.select("k", "a", "eff_from", "eff_to", "is_current", "change_reason", "version").checkpoint()
    batch = snaps([(1, "w", t[3]), (1, "y", t[5]), (1, "x", t[2]), (1, "q", t[7]), (3, "n", t[0])])
    assert rows(late_snapshots(history, batch, ["k"], "ts"), "k", "a") == [(1, "w")]
    merged = scd2_merge(history, batch, ["k"], "ts", ["a"])
    assert rows(merged.filter("is_current"), "k", "a") == [(1, "q"), (2, "z"), (3, "n")]
