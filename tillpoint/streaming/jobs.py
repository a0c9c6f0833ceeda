"""Structured Streaming forms of the batch jobs.

The batch builders are the oracles: each stream here is tested to produce
what its batch form produces on the same input (see tests/test_streaming.py).
State lives in the checkpoint location the caller passes (a shared folder
on a cluster); every sink is either append-only by event time or an
idempotent merge keyed by the micro-batch id, so a restarted query or a
lost executor replays without double counting.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.state import LEDGER_COLS
from ..sources.bucketed_state import BUCKETS, bucketed_sink, read_state
from ..sources.readers import TS_MICROS
from ..sources.sinks import SNAPSHOT_COL, latest_snapshot, read_snapshot
from ..operators.merge import TOMBSTONE, upsert


def _zoned(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP event time; the tables carry wall-clock
    TIMESTAMP_NTZ.  With the session zone at UTC the cast keeps the value."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


# T1 -------------------------------------------------------------------------
def land_json_stream(spark: SparkSession, src: str, schema: T.StructType, out: str, checkpoint: str,
                     ingest_date: dt.date | None = None, max_files: int | None = None) -> StreamingQuery:
    """NDJSON landing -> Parquet partitioned by ingestion day.  The event's
    own date stays a column, so late events are kept (in the day they
    arrived), never dropped."""
    r = spark.readStream.schema(schema).option("timestampNTZFormat", TS_MICROS)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    d = F.lit(ingest_date) if ingest_date else F.current_date()
    s = r.json(src).withColumn("_ingest_date", d)
    return (s.writeStream.format("parquet").partitionBy("_ingest_date").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(out))


# T2 -------------------------------------------------------------------------
def sessionize_stream(clicks: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Clicks (user_id, page_url, ts): exact repeats dropped within the
    watermark, then per-user session windows closed ``gap`` after the last
    event.  Events later than the watermark are dropped (and counted in the
    query's progress metrics)."""
    d = _zoned(clicks, "ts").withWatermark("ts", watermark).dropDuplicatesWithinWatermark(
        ["user_id", "page_url", "ts"])
    return d.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").cast("timestamp_ntz").alias("first_ts"),
        F.max("ts").cast("timestamp_ntz").alias("last_ts"))


# T3 -------------------------------------------------------------------------
def attribute_stream(sessions: DataFrame, orders: DataFrame, within: str = "1 day",
                     watermark: str = "1 day") -> DataFrame:
    """Stream-stream left outer join: every session event, with each order
    of the same user placed in [event_ts, event_ts + within].  An event
    without an order is emitted once the watermark passes its window."""
    s = _zoned(sessions, "event_ts").withWatermark("event_ts", watermark).alias("s")
    o = _zoned(orders, "order_ts").withWatermark("order_ts", watermark).alias("o")
    cond = ((F.col("s.user_id") == F.col("o.o_user_id")) & (F.col("o.order_ts") >= F.col("s.event_ts"))
            & (F.col("o.order_ts") <= F.col("s.event_ts") + F.expr(f"INTERVAL {within}")))
    return s.join(o, cond, "leftOuter").select(
        "s.user_id", F.col("s.event_ts").cast("timestamp_ntz").alias("session_ts"), "o.invoice_no",
        F.col("o.order_ts").cast("timestamp_ntz").alias("order_ts"))


# T4 -------------------------------------------------------------------------
def hourly_picks_stream(picks: DataFrame, watermark: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) hourly windows per warehouse."""
    w = F.window("picked_at", "1 hour", slide) if slide else F.window("picked_at", "1 hour")
    return _zoned(picks, "picked_at").withWatermark("picked_at", watermark).groupBy("warehouse_id", w.alias("w")).agg(
        F.sum("quantity").alias("units_picked"), F.count(F.lit(1)).alias("picks"),
        F.sum("duration_ms").alias("duration_ms"))


# T5 / T6 --------------------------------------------------------------------
def _current_state(spark: SparkSession, root: str, schema: T.StructType) -> tuple[DataFrame, int]:
    latest = latest_snapshot(spark, root)
    if latest is None:  # no snapshot yet; an unreadable one is an error
        return spark.createDataFrame([], schema), -1
    return read_snapshot(spark, root, latest), latest


def snapshot_merge_sink(root: str, schema: T.StructType, merge):
    """foreachBatch sink: state(batch) = merge(state(previous batch), batch),
    written as snapshot ``batch_id``.  A replayed batch id whose snapshot
    already exists is skipped, so the sink is idempotent."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cur, last = _current_state(spark, root, schema)
        if batch_id <= last:
            return
        new = merge(cur, batch)
        new.write.mode("overwrite").parquet(f"{root}/{SNAPSHOT_COL}={batch_id}")
    return sink


def keyed_upsert_stream(stream: DataFrame, root: str, checkpoint: str, keys: list[str],
                        order_col: str, buckets: int = BUCKETS) -> StreamingQuery:
    """T5: last-writer-wins keyed table (K1-K4) maintained from a stream, in
    hash buckets, of which a batch rewrites those of its keys."""
    merge = lambda cur, b: upsert(cur, b, keys, order_col)
    return (stream.writeStream.foreachBatch(bucketed_sink(root, stream.schema, keys, merge, buckets))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stored_ledger_schema(cdc: DataFrame) -> T.StructType:
    """The stored form of returns_ledger: its columns and the tombstone."""
    return T.StructType([*cdc.select(*LEDGER_COLS).schema.fields, T.StructField(TOMBSTONE, T.BooleanType(), True)])


def merge_cdc(cur: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(cur, batch.select(*LEDGER_COLS, "op"), ["return_id"], "return_ts", op_col="op", tombstones=True)


def cdc_ledger_stream(stream: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """returns_ledger (C1) maintained from a CDC stream, in hash buckets.
    Micro-batches need not arrive in change order, so deletes are kept as
    tombstones in the stored state; :func:`read_ledger` hides them."""
    sink = bucketed_sink(root, stored_ledger_schema(stream), ["return_id"], merge_cdc, buckets)
    return (stream.writeStream.foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_ledger(spark: SparkSession, root: str, cdc: DataFrame) -> DataFrame:
    """The ledger that ``cdc`` (for its types) maintains under ``root``."""
    return read_state(spark, root, stored_ledger_schema(cdc)).filter(~F.col(TOMBSTONE)).drop(TOMBSTONE)
