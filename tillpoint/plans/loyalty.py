"""C6 with expiry: loyalty points as lots that redemptions use up first in,
first out, and that lapse a fixed time after they were earned.

Per member, points earned so far and points used so far are positions on one
line.  A lot is the interval of points that its event earned.  A redemption of
``r`` points begins where the one before it ended, or behind the last lot that
has lapsed by then, whichever is further: ``end = max(end before, lapsed) +
r``.  That recurrence has a closed form in running aggregates,

    end = redeemed + running max of (lapsed - redeemed before),

so no member is folded row by row.  What a redemption took from a lot is the
overlap of their intervals; the intervals of a kind never overlap, so cutting
the line at all their ends gives the matches in one ordered pass, without
pairs.  Both passes run in buckets with summaries (``operators/sequence.py``):
days along time, ``BUCKET_POINTS`` along the line.  A lot and a redemption
have at least one point, so a bucket holds at most that many of each, however
many rows a member has.

Defined results: events of no points make no lot and no match; a redemption
beyond what is there takes points earned later, until then the balance is
below zero; a lot lapses before an event of the same instant; on equal times
events go by id; events without a member are left out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import last_known, next_value, running, running_sum

EXPIRY_DAYS = 365
BUCKET_POINTS = 10_000


def point_intervals(events: DataFrame, as_of: dt.datetime, expiry_days: int = EXPIRY_DAYS) -> DataFrame:
    """``member_id, event_id, kind (EARN, REDEEM), at, expiry_ts, first,
    last``: the points of every event up to ``as_of`` as [first, last)."""
    e = events.filter(F.col("member_id").isNotNull() & (F.col("points") > 0) & (F.col("event_ts") <= F.lit(as_of))).select(
        "member_id", "event_id", F.when(F.col("event_type") == "EARN", "EARN").otherwise("REDEEM").alias("kind"),
        F.col("event_ts").alias("at"), "points")
    earn = F.col("kind") == "EARN"
    lapse = F.timestamp_add("DAY", F.lit(expiry_days), F.col("at"))
    e = e.select("*", F.when(earn, lapse).alias("expiry_ts"))
    none = F.lit(None).cast("bigint")
    line = e.select("*", F.lit(1).alias("rank"), F.when(earn, F.col("points")).alias("earned"),
                    F.when(~earn, F.col("points")).alias("redeemed"), none.alias("lapsed"))
    marks = e.filter(earn & (lapse <= F.lit(as_of))).select(
        "member_id", "event_id", F.lit("LAPSE").alias("kind"), F.col("expiry_ts").alias("at"), "points", "expiry_ts",
        F.lit(0).alias("rank"), none.alias("earned"), none.alias("redeemed"), F.col("points").alias("lapsed"))
    order = ["at", "rank", "event_id"]
    t = running(line.unionByName(marks), ["member_id"], order,
                sums={"all_earned": "earned", "all_redeemed": "redeemed", "all_lapsed": "lapsed"}).checkpoint()
    t = t.withColumn("lead", F.when(F.col("kind") == "REDEEM", F.col("all_lapsed") - F.col("all_redeemed") + F.col("redeemed")))
    t = running(t, ["member_id"], order, maxima={"furthest": "lead"}).filter(F.col("kind") != "LAPSE")
    last = F.when(F.col("kind") == "EARN", F.col("all_earned")).otherwise(F.col("all_redeemed") + F.col("furthest"))
    return t.select("member_id", "event_id", "kind", "at", "expiry_ts", (last - F.col("points")).alias("first"), last.alias("last")).checkpoint()


def point_matches(intervals: DataFrame, bucket_points: int = BUCKET_POINTS) -> DataFrame:
    """``member_id, lot_id, redemption_id, points``: which redemption took how
    many points of which lot."""
    id_ = F.struct(F.col("event_id").alias("id"))
    gone = F.struct(F.lit(None).cast("bigint").alias("id"))
    lot, end = F.col("kind") == "EARN", F.lit(None).cast("struct<id:bigint>")
    cuts = (intervals.select("member_id", "event_id", F.col("first").alias("pos"), F.lit(1).alias("rank"),
                             F.when(lot, id_).otherwise(end).alias("lot"), F.when(~lot, id_).otherwise(end).alias("use"))
            .unionByName(intervals.select("member_id", "event_id", F.col("last").alias("pos"), F.lit(0).alias("rank"),
                                          F.when(lot, gone).otherwise(end).alias("lot"), F.when(~lot, gone).otherwise(end).alias("use"))))
    bucket = F.floor(F.col("pos") / bucket_points)
    order = ["pos", "rank", "event_id"]
    t = last_known(cuts, ["member_id"], order, {"in_lot": "lot", "in_use": "use"}, bucket).checkpoint()
    t = next_value(t, ["member_id"], order, "pos", "to", bucket)
    return t.filter("to > pos AND in_lot.id IS NOT NULL AND in_use.id IS NOT NULL").select(
        "member_id", F.col("in_lot.id").alias("lot_id"), F.col("in_use.id").alias("redemption_id"), (F.col("to") - F.col("pos")).alias("points"))


def loyalty_lots(events: DataFrame, as_of: dt.datetime, expiry_days: int = EXPIRY_DAYS) -> DataFrame:
    """Every lot at ``as_of``: points earned, redeemed, expired, remaining."""
    intervals = point_intervals(events, as_of, expiry_days)
    used = point_matches(intervals).groupBy("lot_id").agg(F.sum("points").alias("used"))
    lots = intervals.filter(F.col("kind") == "EARN").join(used, F.col("event_id") == F.col("lot_id"), "left")
    earned, redeemed = F.col("last") - F.col("first"), F.coalesce(F.col("used"), F.lit(0))
    over = F.col("expiry_ts") <= F.lit(as_of)
    return lots.select(
        F.col("event_id").alias("lot_id"), "member_id", F.col("at").alias("earned_ts"), "expiry_ts", earned.alias("points_earned"),
        redeemed.alias("points_redeemed"), F.when(over, earned - redeemed).otherwise(F.lit(0)).alias("points_expired"),
        F.when(over, F.lit(0)).otherwise(earned - redeemed).alias("points_remaining"))


def ledger_with_expiry(ledger: DataFrame, lots: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The ledger up to ``as_of`` with an EXPIRE entry for what each lapsed
    lot had left (entry id: -1 - the lot's), balances running over all."""
    gone = lots.filter("points_expired > 0").select(
        (-1 - F.col("lot_id")).alias("entry_id"), "member_id", (-F.col("points_expired")).alias("points_delta"),
        F.col("expiry_ts").alias("event_ts"), F.lit("EXPIRE").alias("event_type"), F.col("lot_id").cast("string").alias("reference_id"),
        F.lit(None).cast("timestamp_ntz").alias("expiry_ts"))
    cols = gone.columns
    every = ledger.filter(F.col("event_ts") <= F.lit(as_of)).select(*cols).unionByName(gone)
    # ids of expiries are below zero, so they come first within an instant
    out = running_sum(every.checkpoint(), ["member_id"], ["event_ts", "entry_id"], "points_delta", "running_balance")
    return out.select("entry_id", "member_id", "points_delta", "running_balance", "event_ts", "event_type", "reference_id", "expiry_ts")
