"""K2 from a stream with keyed state equals the batch form."""

import tempfile
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from tillpoint.plans import state as st
from tillpoint.sources import testdata as td
from tillpoint.sources.bucketed_state import read_state
from tillpoint.streaming import sessions as ss

COLS = ("session_id", "user_id", "started_ts", "last_event_ts", "cart_value", "cart_items", "current_screen", "platform", "geo_country")


def folder():
    return tempfile.mkdtemp(prefix="tillpoint-sessions-")


def test_stream_equals_batch_and_idle_sessions_leave(spark):
    events = td.mobile_events(spark, SF_SMALL)
    src, root, ck = folder(), folder(), folder()
    for week in range(5):  # one file after the other, in order of time: nothing is late
        events.filter(F.floor((F.dayofmonth("event_ts") - 1) / 7) == week).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = ss.session_state_stream(stream, root, ck)
    query.awaitTermination()
    batch = st.session_state_of_feed(events)
    stored = read_state(spark, root, ss.session_table(spark.createDataFrame([], ss.OUTPUT)).schema)
    assert rows(stored, *COLS) == rows(batch, *COLS)
    kept = spark.read.format("statestore").option("path", ck).option("stateVarName", "session").load()
    last = events.agg(F.max(F.unix_millis(F.col("event_ts").cast("timestamp")))).first()[0]
    alive = {r.session_id for r in batch.filter(F.col("last_event_ts") + ss.DAY_MS > last - 3_600_000).collect()}
    assert {r.key.session_id for r in kept.collect()} == alive
    closed = {r.session_id for r in stored.filter("version.closed").collect()}
    assert closed | alive == {r.session_id for r in batch.collect()} and not closed & alive and closed
    assert spark.conf.get(ss.PROVIDER[0], None) != ss.PROVIDER[1]


def test_sessions_by_time_to_live(spark):
    events = td.mobile_events(spark, SF_SMALL)
    src = folder()
    events.coalesce(1).write.mode("overwrite").parquet(src)
    sessions = st.session_state_of_feed(events).count()
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    spark.conf.set(*ss.PROVIDER)
    try:
        query = (ss.session_table(ss.session_stream(stream, ttl_ms=3_600_000)).writeStream.format("memory").queryName("ttl_sessions")
                 .outputMode("update").start())  # by processing time a query goes on until it is stopped
        deadline = time.monotonic() + 60
        while spark.table("ttl_sessions").select("session_id").distinct().count() < sessions and time.monotonic() < deadline:
            time.sleep(1)
        query.stop()
    finally:
        spark.conf.unset(ss.PROVIDER[0])
    got = spark.table("ttl_sessions").groupBy("session_id").agg(F.max("cart_items").alias("cart_items"), F.min("started_ts").alias("started_ts"))
    assert rows(got, "session_id", "cart_items", "started_ts") == rows(st.session_state_of_feed(events), "session_id", "cart_items", "started_ts")


def test_ties_go_to_the_larger_event_id(spark):
    e = td.mobile_events(spark, SF_SMALL).limit(1)
    at = e.select("event_ts").first()[0]

    def event(i, kind, platform):
        return (e.withColumn("event_id", F.lit(i)).withColumn("event_ts", F.lit(at)).withColumn("platform", F.lit(platform))
                .withColumn("properties", F.create_map(F.lit("event_type"), F.lit(kind))))

    both = event("a", "view", "ios").unionByName(event("b", "click", "android"))
    got = st.session_state_of_feed(both).first()
    assert (got.current_screen, got.platform) == ("click", "android")
    none = both.withColumn("items", F.lit(None).cast(both.schema["items"].dataType)).withColumn("properties", F.lit(None).cast("map<string,string>"))
    got = st.session_state_of_feed(none).first()
    assert (got.cart_items, got.current_screen) == (0, None)
