"""F6 as a daily snapshot: a row per day, sku and warehouse with stock,
allocations, goods under way and the moving average cost.

The average cost after a movement is an affine function of the one before:

    receipt of x units at cost u onto q units:  c -> (q * c + x * u) / (q + x)
    anything else:                              c -> c

(with q <= 0 a receipt sets c to u).  The stock before each movement does not
depend on costs, so it comes first, by a running sum.  Affine steps compose
to affine steps, and that is associative: the steps of an hour are composed
in order, hours to days, days along a key, each level in parallel.  A key's
rows are never in one task; what one task folds is a key's receipts of an
hour, its hours of a day, or its days, one small entry each.

The state after every day with movements is then spread over the days until
the next one, so the snapshot of any span of days needs no self join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["sku", "warehouse_id"]
# Fixed values (ours): what a unit of a movement type adds to stock, to
# allocations and to goods under way.  Other types change nothing.
EFFECTS = {"IN": (1, 0, 0), "OUT": (-1, 0, 0), "ALLOCATE": (0, 1, 0), "RELEASE": (0, -1, 0), "DISPATCH": (0, 0, 1),
           "ARRIVE": (1, 0, -1), "ADJUST": (1, 0, 0)}


def _effect(part: int) -> Column:
    types = F.create_map(*[x for t, e in EFFECTS.items() for x in (F.lit(t), F.lit(e[part]))])
    return F.coalesce(F.try_element_at(types, F.col("movement_type")), F.lit(0)) * F.coalesce("quantity", F.lit(0))


def _composed(steps: Column) -> Column:
    """One step out of an ordered array of steps ``(keep, add)``: first to
    last, c -> keep * c + add."""
    return F.aggregate(steps, F.struct(F.lit(1.0).alias("keep"), F.lit(0.0).alias("add")),
                       lambda acc, s: F.struct((acc["keep"] * s["keep"]).alias("keep"), (acc["add"] * s["keep"] + s["add"]).alias("add")))


def daily_states(movements: DataFrame) -> DataFrame:
    """State after every day with movements, and the next such day.  Rows
    without a sku, warehouse or time are left out."""
    m = movements.filter("sku IS NOT NULL AND warehouse_id IS NOT NULL AND movement_ts IS NOT NULL").select(
        *KEY, F.to_date("movement_ts").alias("day"), "movement_id", "movement_ts", F.col("unit_cost").cast("double").alias("u"),
        *[_effect(i).cast("bigint").alias(n) for i, n in enumerate(("stock", "allocated", "under_way"))])
    # the running stock, within a day and from day to day; rows stay where
    # this window put them (by key and day) up to the steps of a day
    within = Window.partitionBy(*KEY, "day").orderBy("movement_ts", "movement_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = m.groupBy(*KEY, "day").agg(F.sum("stock").alias("total")).select(
        *KEY, "day", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("opening"))
    m = m.withColumn("local", F.sum("stock").over(within)).join(opening, [*KEY, "day"]).withColumn("after", F.col("local") + F.col("opening"))
    before, x, u = F.col("after") - F.col("stock"), F.col("stock"), F.col("u")
    receipt = (x > 0) & u.isNotNull()
    onto = before > 0
    total = (before + x).cast("double")
    step = F.when(receipt, F.struct(
        "movement_ts", "movement_id", F.when(onto, before / total).otherwise(F.lit(0.0)).alias("keep"),
        F.when(onto, x * u / total).otherwise(u).alias("add"), u.alias("u")))
    sums = [F.sum(c).alias(c) for c in ("stock", "allocated", "under_way")]
    hours = m.groupBy(*KEY, "day", F.hour("movement_ts").alias("hour")).agg(
        F.array_sort(F.collect_list(step)).alias("steps"), *sums, F.max("movement_ts").alias("last_ts")).select(
        *KEY, "day", "hour", _composed(F.col("steps")).alias("step"), F.get("steps", F.lit(0))["u"].alias("u"),
        "stock", "allocated", "under_way", "last_ts")
    days = hours.groupBy(*KEY, "day").agg(
        F.array_sort(F.collect_list(F.struct("hour", "step"))).alias("hours"), F.min_by("u", F.when(F.col("u").isNotNull(), F.col("hour"))).alias("u"),
        *sums, F.max("last_ts").alias("last_ts")).select(
        *KEY, "day", _composed(F.col("hours.step")).alias("step"), "u", "stock", "allocated", "under_way", "last_ts")
    keys = days.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("day", "step", "stock", "allocated", "under_way", "last_ts"))).alias("days"),
        F.min_by("u", F.when(F.col("u").isNotNull(), F.col("day"))).alias("first_cost"))
    state = "struct<day:date,on_hand:bigint,allocated:bigint,in_transit:bigint,cost:double,last_ts:timestamp_ntz>"
    none = F.array().cast(f"array<{state}>")

    def after(acc, d):
        new = F.struct(d["day"].alias("day"), (acc["on_hand"] + d["stock"]).alias("on_hand"),
                       (acc["allocated"] + d["allocated"]).alias("allocated"), (acc["in_transit"] + d["under_way"]).alias("in_transit"),
                       (d["step"]["keep"] * acc["cost"] + d["step"]["add"]).alias("cost"), d["last_ts"].alias("last_ts"))
        return F.struct(new["on_hand"].alias("on_hand"), new["allocated"].alias("allocated"), new["in_transit"].alias("in_transit"),
                        new["cost"].alias("cost"), F.concat(acc["out"], F.array(new)).alias("out"))

    zero = F.lit(0).cast("bigint")
    # before its first receipt a key is valued at the cost of that receipt
    start = F.struct(zero.alias("on_hand"), zero.alias("allocated"), zero.alias("in_transit"), F.col("first_cost").alias("cost"), none.alias("out"))
    states = keys.select(*KEY, F.aggregate("days", start, after, lambda acc: acc["out"]).alias("states"))
    fields = ("day", "on_hand", "allocated", "in_transit", "cost", "last_ts")
    return states.select(*KEY, F.inline(F.transform("states", lambda s, i: F.struct(
        *[s[c].alias(c) for c in fields], F.get(F.col("states"), i + 1)["day"].alias("next_day")))))


def inventory_daily_snapshot(movements: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """The partitions of the days ``first`` to ``last``: a row per day and key
    from the key's first movement on.  Costs are rounded to four places, half
    up (a billionth is added, as they are doubles); a key without any receipt
    has none."""
    s = daily_states(movements)
    begin = F.greatest("day", F.lit(first))
    end = F.least(F.coalesce(F.date_sub("next_day", 1), F.lit(last)), F.lit(last))
    # all that is the same on every day of a state comes before its days
    rows = s.filter(begin <= end).select(
        "sku", F.substring("warehouse_id", 3, 10).cast("bigint").alias("warehouse_sk"), F.col("on_hand").alias("on_hand_units"),
        F.col("allocated").alias("allocated_units"), F.col("in_transit").alias("in_transit_units"),
        (F.col("on_hand") - F.col("allocated")).alias("available_units"),
        F.round(F.col("cost") + 1e-9, 4).cast("decimal(12,4)").alias("avg_cost"), F.col("last_ts").alias("last_movement_ts"),
        F.sequence(begin, end).alias("days"))
    return rows.select(*[c for c in rows.columns if c != "days"], F.explode("days").alias("snapshot_date"))
