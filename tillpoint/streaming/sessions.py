"""K2 from a stream: session state kept per key with ``transformWithState``.

Each session has one value in the state store and one event-time timer, set
``idle`` after its last event.  A micro-batch folds a session's new events
into the value and emits the session as it stands; when the watermark passes
the timer the session is emitted once more as closed and leaves the state, so
the state holds the sessions of the last ``idle`` plus the watermark, however
long the stream runs.  What is emitted goes into the keyed table
(``sources/bucketed_state.py``), where it equals the batch form
(:func:`plans.state.session_state_of_feed`) as long as no session pauses
longer than ``idle``; one that does begins anew in the state.

Without a watermark the state can live by processing time instead: with
``ttl_ms`` a session's value expires that long after its last change.  Such a
stream runs until it is stopped; Spark does not end it when input is used up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.merge import upsert
from ..plans.state import SESSION_EVENT_COLS, session_events
from ..sources.bucketed_state import BUCKETS, bucketed_sink

DAY_MS = 24 * 3600 * 1000
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = ("user_id string, started_ts bigint, last_event_ts bigint, last_id string, cart_cents bigint, cart_items bigint, "
         "current_screen string, platform string, geo_country string")
FIELDS = [f.split()[0] for f in STATE.split(", ")]
OUTPUT = f"session_id string, {STATE}, closed boolean"


class SessionProcessor(StatefulProcessor):
    """``idle_ms``: event time after which a session leaves; ``ttl_ms``:
    instead, processing time after its last change."""

    def __init__(self, idle_ms: int = DAY_MS, ttl_ms: int | None = None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE, self.ttl_ms)

    def row(self, key, state, closed: bool) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *state, closed]], columns=["session_id", *FIELDS, "closed"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = dict(zip(FIELDS, self.session.get())) if self.session.exists() else None
        for events in rows:
            latest = events.sort_values(["at_ms", "event_id"]).iloc[-1]
            first, cents, items = int(events["at_ms"].min()), int(events["cents"].sum()), int(events["units"].sum())
            if state is None:
                state = {"user_id": latest["user_id"], "started_ts": first, "last_event_ts": -1, "last_id": "", "cart_cents": 0, "cart_items": 0}
            state["started_ts"] = min(state["started_ts"], first)
            state["cart_cents"] += cents
            state["cart_items"] += items
            if (int(latest["at_ms"]), latest["event_id"]) >= (state["last_event_ts"], state["last_id"]):
                state |= {"last_event_ts": int(latest["at_ms"]), "last_id": latest["event_id"], "current_screen": latest["screen"],
                          "platform": latest["platform"], "geo_country": latest["geo_country"], "user_id": latest["user_id"]}
        values = tuple(state[f] for f in FIELDS)
        self.session.update(values)
        if self.ttl_ms is None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(state["last_event_ts"] + self.idle_ms)
        yield self.row(key, values, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.session.exists():
            values = self.session.get()
            self.session.clear()
            yield self.row(key, values, True)

    def close(self) -> None:
        pass


def session_stream(mobile_events: DataFrame, idle_ms: int = DAY_MS, watermark: str = "1 hour", ttl_ms: int | None = None) -> DataFrame:
    """Sessions as they change (and once more as ``closed``)."""
    events = session_events(mobile_events.withColumn("event_ts", F.col("event_ts").cast("timestamp")))
    if ttl_ms is None:
        events = events.withWatermark("event_ts", watermark)
    return events.groupBy("session_id").transformWithStateInPandas(
        SessionProcessor(idle_ms, ttl_ms), OUTPUT, "Update", "EventTime" if ttl_ms is None else "ProcessingTime")


def session_table(sessions: DataFrame) -> DataFrame:
    """The columns of K2 from what the stream emits, and the tie-breaker."""
    return sessions.select(
        "session_id", "user_id", "started_ts", "last_event_ts", (F.col("cart_cents") / 100).cast("decimal(12,2)").alias("cart_value"),
        "cart_items", "current_screen", "platform", "geo_country", F.struct("last_event_ts", "cart_items", "closed").alias("version"))


def session_state_stream(mobile_events: DataFrame, root: str, checkpoint: str, idle_ms: int = DAY_MS,
                         watermark: str = "1 hour", buckets: int = BUCKETS) -> StreamingQuery:
    """K2's table under ``root``, maintained from a stream of events."""
    spark = mobile_events.sparkSession
    table = session_table(session_stream(mobile_events, idle_ms, watermark))
    sink = bucketed_sink(root, table.schema, ["session_id"], lambda cur, b: upsert(cur, b, ["session_id"], "version"), buckets)
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)  # the query keeps it from its start
    try:
        return (table.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


__all__ = ["SESSION_EVENT_COLS", "SessionProcessor", "session_state_stream", "session_stream", "session_table"]
