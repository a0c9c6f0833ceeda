"""Mutable state as DataFrame functions: CDC ledger (C1, S7), SCD-2 histories
(C2-C5), ledgers (C6, C7), point-in-time lookup (C8) and keyed last-writer
tables (K1-K4).  Each returns the new state; writing it as a new snapshot
is the caller's job (:mod:`sources.sinks`)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import decimal_ratio
from ..operators.joins import as_of_carry
from ..operators.merge import TOMBSTONE, history_id, latest_per_key, scd2_from_changes, scd2_merge, scd2_splice, upsert
from ..operators.sequence import running_sum

LEDGER_COLS = ["return_id", "invoice_no", "customer_sk", "return_ts", "refund_amount",
               "reason_code", "status"]


# C1 / S7 --------------------------------------------------------------------
def apply_returns_cdc(ledger: DataFrame, cdc: DataFrame, tombstones: bool = False) -> DataFrame:
    """Apply a batch of I/U/D changes to returns_ledger (latest change
    per return_id wins; 'D' removes the row; replaying the last batch is a
    no-op).  With ``tombstones`` the result is the stored form, which still
    knows what was deleted, so that replaying any older batch is a no-op too;
    :func:`visible_ledger` hides the deleted rows."""
    kept = [TOMBSTONE] if TOMBSTONE in ledger.columns else []
    return upsert(ledger.select(*LEDGER_COLS, *kept), cdc.select(*LEDGER_COLS, "op"),
                  ["return_id"], "return_ts", op_col="op", tombstones=tombstones)


def visible_ledger(stored: DataFrame) -> DataFrame:
    """The rows of a stored ledger that are not deleted."""
    return stored.filter(~F.col(TOMBSTONE)).drop(TOMBSTONE)


def merged_returns_cdc(cdc: DataFrame) -> DataFrame:
    """Latest change per (return_id, snapshot_date); deletes flagged."""
    last = latest_per_key(cdc.select(*LEDGER_COLS, "op", "snapshot_date"),
                          ["return_id", "snapshot_date"], ["return_ts"])
    return last.select(*LEDGER_COLS, (F.col("op") == "D").alias("is_deleted"), "snapshot_date")


# C2-C5 ----------------------------------------------------------------------
ADDRESS_ATTRS = ["address_line1", "address_city", "address_region", "address_country",
                 "address_postal"]
HISTORY_COLS = ["history_id", "customer_sk", *ADDRESS_ATTRS, "eff_from", "eff_to",
                "is_current", "change_reason"]


def customer_address_history(snapshots: DataFrame) -> DataFrame:
    """C2 from a stream of address snapshots (one SCD-2 operator serves
    C2-C5; only keys and tracked columns differ)."""
    h = scd2_from_changes(snapshots, ["customer_sk"], "ts", ADDRESS_ATTRS, key_id="customer_sk",
                          reason_change="address_change")
    return h.select(*HISTORY_COLS)


def customer_address_history_incremental(snapshots: DataFrame, split: dt.datetime) -> DataFrame:
    """C2 built in two runs: history from the snapshots before ``split``,
    then the later snapshots merged in with :func:`scd2_merge`."""
    first = scd2_from_changes(snapshots.filter(F.col("ts") < F.lit(split)), ["customer_sk"], "ts",
                              ADDRESS_ATTRS, reason_change="address_change")
    first = first.select("customer_sk", *ADDRESS_ATTRS, "eff_from", "eff_to", "is_current",
                         "change_reason", "version")
    merged = scd2_merge(first, snapshots.filter(F.col("ts") >= F.lit(split)), ["customer_sk"], "ts",
                        ADDRESS_ATTRS, reason_change="address_change")
    return merged.withColumn("history_id", history_id("customer_sk")).select(
        *HISTORY_COLS)


def customer_address_history_spliced(batches: list[DataFrame]) -> DataFrame:
    """C2 from batches of snapshots in any order of arrival."""
    at = ["customer_sk", *ADDRESS_ATTRS, "ts"]
    seen = empty_like(batches[0], ["customer_sk", "ts"])
    history = empty_like(batches[0], at).select(
        "customer_sk", *ADDRESS_ATTRS, F.col("ts").alias("eff_from"), F.col("ts").alias("eff_to"), F.lit(True).alias("is_current"),
        F.lit("").alias("change_reason"), F.lit(0).cast("bigint").alias("version"))
    for batch in batches:
        history, seen = scd2_splice(history, seen, batch, ["customer_sk"], "ts", ADDRESS_ATTRS, reason_change="address_change")
    return history.withColumn("history_id", history_id("customer_sk")).select(*HISTORY_COLS)


SCD2_SPECS = {
    # table: (keys, tracked attributes)
    "acid_customer_address_history": (["customer_sk"], ADDRESS_ATTRS),
    "acid_supplier_terms_history": (["supplier_sk"], ["payment_terms_days", "discount_pct"]),
    "dim_employee_history": (["employee_sk"], ["role", "department", "home_store_sk", "salary_band"]),
    "dim_store_history": (["store_sk"], ["store_type", "manager_employee_sk", "sq_ft"]),
}


def scd2_table(table: str, snapshots: DataFrame, ts_col: str) -> DataFrame:
    """C3-C5 through the same operator; C4 adds its year partition columns."""
    keys, tracked = SCD2_SPECS[table]
    h = scd2_from_changes(snapshots, keys, ts_col, tracked)
    if table == "dim_employee_history":
        h = h.withColumn("eff_from_year", F.year("eff_from").cast("bigint")).withColumn(
            "_partition_year", F.trunc(F.col("eff_from").cast("date"), "year"))
    return h


# C6 -------------------------------------------------------------------------
def loyalty_points_ledger(loyalty_events: DataFrame, expiry_days: int = 365) -> DataFrame:
    """EARN adds, REDEEM subtracts; running balance per member in event
    order (ties by entry id); earned points expire after ``expiry_days``."""
    e = loyalty_events.select(
        F.col("event_id").alias("entry_id"), "member_id",
        F.when(F.col("event_type") == "EARN", F.col("points")).otherwise(-F.col("points")).alias("points_delta"),
        "event_ts", "event_type", F.col("tx_id").alias("reference_id"),
        F.when(F.col("event_type") == "EARN", F.timestamp_add("DAY", F.lit(expiry_days), F.col("event_ts")))
        .alias("expiry_ts"))
    r = running_sum(e, ["member_id"], ["event_ts", "entry_id"], "points_delta", "running_balance")
    return r.select("entry_id", "member_id", "points_delta", "running_balance", "event_ts",
                    "event_type", "reference_id", "expiry_ts")


# C7 -------------------------------------------------------------------------
def append_adjustments(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Append-only audit log: rows whose adjustment_id is already logged are
    not appended again, so a replayed batch changes nothing."""
    new = batch.join(log.select("adjustment_id"), "adjustment_id", "left_anti")
    return log.unionByName(new.select(log.columns))


def adjustment_audit(log: DataFrame) -> DataFrame:
    return log.select(
        "*",
        F.timestamp_diff("MINUTE", F.col("adjusted_at"), F.col("approved_at")).alias("approval_lag_minutes"),
        (F.col("approved_by") == F.col("adjusted_by")).alias("self_approved"),
        F.col("approved_by").isNull().alias("pending"))


# C8 -------------------------------------------------------------------------
def sales_with_address(sales: DataFrame, history: DataFrame) -> DataFrame:
    j = as_of_carry(sales.select("invoice_no", "customer_sk", "invoice_ts", "line_total"), history,
                    "customer_sk", "customer_sk", "invoice_ts", ["history_id", "address_city"])
    return j.select("invoice_no", "customer_sk", "invoice_ts", "line_total", "history_id", "address_city")


# K1-K4 ----------------------------------------------------------------------
def inventory_realtime(state: DataFrame, feed: DataFrame) -> DataFrame:
    cols = ["warehouse_id", "sku", "on_hand", "allocated", "last_updated_ts"]
    s = upsert(state.select(*cols), feed.select(*cols), ["warehouse_id", "sku"], "last_updated_ts")
    return s.select("warehouse_id", "sku", "on_hand", "allocated",
                    (F.col("on_hand") - F.col("allocated")).alias("available"), "last_updated_ts")


def session_state(events: DataFrame) -> DataFrame:
    """K2 per session (user and day): start, last event, cart value and
    items from purchases, current screen = type of the latest event."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    purchase = F.col("event_type") == "purchase"
    uid = F.col("user_id")
    return events.groupBy(
        F.concat_ws("-", uid.cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        uid.cast("string").alias("user_id"),
    ).agg(
        F.min(ms).alias("started_ts"), F.max(ms).alias("last_event_ts"),
        F.coalesce(F.sum(F.when(purchase, F.col("value").cast("decimal(10,2)"))),
                   F.lit(0)).cast("decimal(12,2)").alias("cart_value"),
        F.count(F.when(purchase, 1)).alias("cart_items"),
        F.max_by("event_type", "ts").alias("current_screen"),
        F.first(F.when(uid % 2 == 0, "ios").otherwise("android")).alias("platform"),
        F.first(F.when(uid % 3 == 0, "US").when(uid % 3 == 1, "GB").otherwise("DE")).alias("geo_country"))


# Fixed value (ours): event types that put their items into the cart.
CART_EVENTS = ["click"]
SESSION_EVENT_COLS = ["session_id", "user_id", "event_ts", "at_ms", "event_id", "screen", "platform", "geo_country", "units", "cents"]


def session_events(mobile_events: DataFrame) -> DataFrame:
    """What sessions are made of, from the app's own feed: its session id,
    platform and country; cents and units of the items of cart events.
    Events without a session id are left out."""
    cart = F.coalesce(F.col("properties")["event_type"].isin(*CART_EVENTS), F.lit(False))
    items = F.when(cart, F.coalesce("items", F.array().cast("array<struct<sku:string,qty:int,price:decimal(10,2)>>")))

    def total(value):
        return F.coalesce(F.aggregate(F.transform(items, lambda i: F.coalesce(value(i).cast("bigint"), F.lit(0).cast("bigint"))),
                                      F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))

    return mobile_events.filter(F.col("context.session_id").isNotNull()).select(
        F.col("context.session_id").alias("session_id"), "user_id", "event_ts",
        F.unix_millis(F.col("event_ts").cast("timestamp")).alias("at_ms"), "event_id", F.col("properties")["event_type"].alias("screen"),
        "platform", F.col("context.country").alias("geo_country"), total(lambda i: i["qty"]).alias("units"),
        total(lambda i: i["qty"] * i["price"] * 100).alias("cents"))


def session_state_of_feed(mobile_events: DataFrame) -> DataFrame:
    """K2 from the app's feed: nothing is invented, and what is current is
    that of the latest event, on equal times of the larger event id."""
    e = session_events(mobile_events)
    last = F.max(F.struct("at_ms", "event_id", "user_id", "screen", "platform", "geo_country"))
    g = e.groupBy("session_id").agg(F.min("at_ms").alias("started_ts"), last.alias("l"), F.sum("cents").alias("c"), F.sum("units").alias("u"))
    return g.select("session_id", "l.user_id", "started_ts", F.col("l.at_ms").alias("last_event_ts"),
                    (F.col("c") / 100).cast("decimal(12,2)").alias("cart_value"), F.col("u").alias("cart_items"),
                    F.col("l.screen").alias("current_screen"), "l.platform", "l.geo_country")


PROMO_COLS = ["customer_id", "promo_id", "eligible", "eligibility_reason", "valid_from_ts",
              "valid_to_ts", "redeemed"]


def promo_eligibility(state: DataFrame, feed: DataFrame) -> DataFrame:
    return upsert(state.select(*PROMO_COLS), feed.select(*PROMO_COLS), ["customer_id", "promo_id"],
                  "valid_from_ts")


def active_promos(state: DataFrame, at: dt.datetime) -> DataFrame:
    """K3 range filter: eligible and valid at instant ``at``."""
    ms = int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return state.filter(F.col("eligible") & (F.col("valid_from_ts") <= ms) & (F.col("valid_to_ts") > ms))


PRICE_COLS = ["sku", "store_id", "price", "list_price", "cost", "updated_ts", "pricing_engine"]


def realtime_price(state: DataFrame, feed: DataFrame) -> DataFrame:
    s = upsert(state.select(*PRICE_COLS), feed.select(*PRICE_COLS), ["sku", "store_id"], "updated_ts")
    return s.select("sku", "store_id", "price", "list_price", "cost",
                    decimal_ratio(F.col("price") - F.col("cost"), F.col("price"), 5, 4,
                                  num_scale=2, den_scale=2).alias("margin_pct"),
                    "updated_ts", "pricing_engine")


def empty_like(df: DataFrame, cols: list[str]) -> DataFrame:
    """An empty table with the schema of ``df[cols]`` (the state before the
    first run)."""
    sub = df.select(*cols)
    return sub.sparkSession.createDataFrame([], sub.schema)
