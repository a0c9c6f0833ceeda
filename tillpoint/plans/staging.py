"""Raw -> staging jobs, and the hourly warehouse KPI table.

Only the input and output schemas of these tables exist in the reference;
each cleaning rule below is our design, stated where it is applied.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import decimal_ratio
from ..operators.joins import trailing_agg
from ..operators.merge import latest_per_key
from ..operators.sequence import prev_value, running_sum


def _addr_hash(*cols: str) -> Column:
    """Hash of an address, whatever its letters' case; a NULL part counts as
    a part of its own, so it cannot shift the others."""
    return F.sha2(F.lower(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit(NULL_PART)) for c in cols])), 256)


NULL_PART = "\x00"


ADDR = ["addr_line1", "addr_city", "addr_region", "addr_country", "addr_postal"]


# S1 -------------------------------------------------------------------------
def cleansed_customers(signups: DataFrame, geocoded: DataFrame, load_date: dt.date) -> DataFrame:
    """Newest signup per customer; e-mail trimmed and lower-cased, phone
    reduced to digits; coordinates from the geocoded address (S6);
    record_hash = SHA-256 of the cleaned attributes."""
    s = signups.select(
        "customer_id", F.lower(F.trim("email")).alias("email_norm"),
        F.regexp_replace("phone", "[^0-9]", "").alias("phone_norm"),
        "first_name", "last_name", *ADDR, "signup_date")
    newest = latest_per_key(s, ["customer_id"], ["signup_date"])
    g = geocoded.select(F.col("raw_addr_hash").alias("__gh"), F.col("lat").alias("geocoded_lat"),
                        F.col("lon").alias("geocoded_lon"))
    j = newest.withColumn("__h", _addr_hash(*ADDR)).join(g, F.col("__h") == F.col("__gh"), "left")
    attrs = ["email_norm", "phone_norm", "first_name", "last_name", *ADDR]
    return j.select(
        "customer_id", "email_norm", "phone_norm", "first_name", "last_name", *ADDR,
        "geocoded_lat", "geocoded_lon",
        F.to_timestamp_ntz(F.col("signup_date"), F.lit("yyyyMMdd")).alias("eff_from_ts"),
        F.sha2(F.concat_ws("|", *[F.col(c) for c in attrs]), 256).alias("record_hash"),
        F.lit(load_date).alias("load_date"))


# S2 -------------------------------------------------------------------------
def cleansed_orders(pos: DataFrame) -> DataFrame:
    """Voided transactions dropped (unknown void flag kept); net = gross -
    discount + tax."""
    keep = pos.filter(~F.coalesce(F.col("void_flag"), F.lit(False)))
    return keep.select(
        F.concat(F.lit("POS-"), F.col("txn_id").cast("string")).alias("order_id"),
        "customer_id", "invoice_no", "txn_ts", "line_count", "gross_amount",
        F.col("discount_amount").alias("discount"), F.col("tax_amount").alias("tax"),
        (F.col("gross_amount") - F.col("discount_amount") + F.col("tax_amount")).cast("decimal(14,2)").alias("net_amount"),
        "tender_type", F.lit("pos").alias("source_feed"), F.to_date("txn_ts").alias("order_date"))


# S3 -------------------------------------------------------------------------
def cleansed_products(feed: DataFrame, load_date: dt.date) -> DataFrame:
    """Newest feed row per sku; names in title case with single spaces,
    category upper, colour lower, size upper; available on ``load_date``
    when it lies in [available_from, discontinued_at)."""
    last = latest_per_key(feed, ["sku"], ["feed_date"])
    ld = F.lit(load_date)
    available = (F.col("available_from") <= ld) & (
        F.col("discontinued_at").isNull() | (F.col("discontinued_at") > ld))
    return last.select(
        "sku", "upc",
        F.initcap(F.trim(F.regexp_replace("name", r"\s+", " "))).alias("name_norm"),
        F.upper(F.trim("category")).alias("category_norm"), "subcategory",
        F.lower(F.trim("color")).alias("color_norm"), F.upper(F.trim("size")).alias("size_norm"),
        "msrp", "cost", "supplier_id", available.alias("available"), ld.alias("load_date"))


# S4 -------------------------------------------------------------------------
def dedup_clickstream(omniture: DataFrame, gap_minutes: int = 30,
                      bot_events_per_minute: int = 10) -> DataFrame:
    """Typed clicks, exact repeats of (user, url, ts) dropped, sessions cut
    at gaps over ``gap_minutes`` per user, bot_score = session event rate
    over ``bot_events_per_minute`` (events per minute of session time plus
    one minute), capped at 1.  Per-user sequencing is two-level (by day), so
    a very active user does not end up in one task."""
    o = omniture.select("user_id", F.to_timestamp_ntz(F.col("event_ts"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
                        F.col("url").alias("page_url"), "ip", "country", "date_ts")
    d = o.groupBy("user_id", "page_url", "ts").agg(F.min("ip").alias("ip"), F.min("country").alias("country"),
                                                   F.min("date_ts").alias("date_ts"))
    order = ["ts", "page_url"]
    d = prev_value(d, ["user_id"], order, "ts", "__prev").checkpoint(eager=True)
    start = F.col("__prev").isNull() | (F.col("ts") > F.timestamp_add("MINUTE", F.lit(gap_minutes), F.col("__prev")))
    s = running_sum(d.withColumn("__start", start.cast("bigint")), ["user_id"], order, "__start", "session_no")
    s = s.checkpoint(eager=True)
    stats = s.groupBy(F.col("user_id").alias("__u"), F.col("session_no").alias("__s")).agg(
        F.count(F.lit(1)).alias("__n"),
        (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).alias("__dur"))
    j = s.join(stats, (s.user_id == stats["__u"]) & (s.session_no == stats["__s"]))
    per_min = 60 // bot_events_per_minute if 60 % bot_events_per_minute == 0 else None
    rate = (decimal_ratio(F.col("__n") * per_min, F.col("__dur") + 60, 4, 3) if per_min
            else decimal_ratio(F.col("__n") * 60, (F.col("__dur") + 60) * bot_events_per_minute, 4, 3))
    return j.select(
        F.concat_ws("-", F.col("user_id"), F.col("session_no").cast("string")).alias("session_id"),
        "user_id", F.col("ts").alias("event_ts"), "page_url", F.lit(None).cast("string").alias("referrer_url"),
        "ip", "country", F.least(rate, F.lit(1).cast("decimal(4,3)")).alias("bot_score"),
        F.lit(None).cast("string").alias("device_type"), "date_ts", F.col("country").alias("country_partition"))


# S5 -------------------------------------------------------------------------
def fraud_scored(txns: DataFrame, signals: DataFrame, lookback_days: int = 1) -> DataFrame:
    """Per transaction: the highest score among the customer's signals in
    the ``lookback_days`` before it (inclusive), their distinct reason codes
    (sorted), and a band by cutoff (0.8 HIGH, 0.5 MEDIUM, else LOW; NONE
    without signals)."""
    # one row per (signal, reason code); the trailing aggregate never builds
    # (transaction, signal) pairs, so a customer with a third of all signals
    # costs a sort per (customer, hour), not a quadratic join
    s = signals.select("customer_id", F.col("signal_ts").cast("timestamp_ntz").alias("__sts"),
                       "score", F.explode_outer("reason_codes").alias("__code"))
    g = trailing_agg(txns.select("txn_id", "customer_id", "txn_ts"), s, ["txn_id", "customer_id", "txn_ts"],
                     "customer_id", "customer_id", "txn_ts", "__sts", lookback_days * 86400,
                     maxes={"__max": F.col("score")}, sets={"signals": F.col("__code")})
    band = (F.when(F.col("__max") >= 0.8, "HIGH").when(F.col("__max") >= 0.5, "MEDIUM")
            .when(F.col("__max").isNotNull(), "LOW").otherwise("NONE"))
    return g.select("txn_id", "customer_id", F.col("__max").cast("decimal(5,4)").alias("fraud_score"),
                    band.alias("risk_band"), "signals", F.col("txn_ts").alias("scored_at"),
                    F.to_date("txn_ts").alias("score_date"))


# S6 -------------------------------------------------------------------------
def geocode(addresses: DataFrame, geography: DataFrame, load_date: dt.date) -> DataFrame:
    """Lookup geocoding: postal-level match (country + postcode, confidence
    0.95), else city-level (country + city, 0.70), else none (0)."""
    # one row per hash: of several spellings of an address the smallest
    a = (addresses.groupBy(_addr_hash(*ADDR).alias("raw_addr_hash")).agg(F.min(F.struct(*ADDR)).alias("__a"))
         .select("raw_addr_hash", *[F.col(f"__a.{c}").alias(c) for c in ADDR]))
    gp = (geography.filter(F.col("postal_code").isNotNull())
          .groupBy(F.col("country_iso2").alias("__pc"), F.col("postal_code").alias("__pp"))
          .agg(F.min("latitude").alias("__plat"), F.min("longitude").alias("__plon")))
    gc = (geography.filter(F.col("postal_code").isNull() & F.col("city").isNotNull())
          .groupBy(F.col("country_iso2").alias("__cc"), F.col("city").alias("__ccity"))
          .agg(F.min("latitude").alias("__clat"), F.min("longitude").alias("__clon")))
    j = (a.join(gp, (a.addr_country == gp["__pc"]) & (a.addr_postal == gp["__pp"]), "left")
         .join(gc, (a.addr_country == gc["__cc"]) & (a.addr_city == gc["__ccity"]), "left"))
    conf = (F.when(F.col("__plat").isNotNull(), F.lit(0.95)).when(F.col("__clat").isNotNull(), F.lit(0.70))
            .otherwise(F.lit(0.0)))
    return j.select(
        "raw_addr_hash", *ADDR,
        F.coalesce("__plat", "__clat").alias("lat"), F.coalesce("__plon", "__clon").alias("lon"),
        conf.cast("decimal(4,3)").alias("confidence"), F.lit("lookup").alias("provider"),
        F.lit(load_date).alias("load_date"))


# S8 -------------------------------------------------------------------------
def normalized_carrier_events(tracking: DataFrame) -> DataFrame:
    """One row per shipment event: SHIPPED, DELIVERED (if delivered) and the
    status event; location text split into city / region / country."""
    ev = F.explode(F.array(
        F.struct(F.lit("SHIPPED").alias("t"), F.col("shipped_at").alias("ts")),
        F.struct(F.lit("DELIVERED").alias("t"), F.col("delivered_at").alias("ts")),
        F.struct(F.upper(F.trim("status")).alias("t"), F.coalesce("delivered_at", "shipped_at").alias("ts"))))
    x = tracking.select("tracking_no", "carrier", "last_location", "date_ts", ev.alias("e"))
    parts = F.split("last_location", ",")
    return x.filter(F.col("e.ts").isNotNull()).select(
        "tracking_no", F.upper(F.trim("carrier")).alias("carrier"), F.col("e.t").alias("event_type"),
        F.col("e.ts").alias("event_ts"), F.trim(F.get(parts, 0)).alias("location_city"),
        F.trim(F.get(parts, 1)).alias("location_region"), F.trim(F.get(parts, 2)).alias("location_country"),
        "date_ts")


# S9 -------------------------------------------------------------------------
META_PATTERN = r"^[^=;]+=[^=;]*(;[^=;]+=[^=;]*)*$"


def _loyalty_checks(raw: DataFrame) -> DataFrame:
    return raw.select(
        "*",
        F.try_to_timestamp(F.col("event_ts_str"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("__ts"),
        F.col("points").try_cast("bigint").alias("__pts"),
        F.coalesce(F.col("meta_raw").rlike(META_PATTERN), F.lit(False)).alias("__meta_ok"))


def parsed_loyalty_events(raw: DataFrame) -> DataFrame:
    """Typed loyalty events: time and points cast, 'k=v;...' meta as a map.
    Rows failing any cast go to :func:`loyalty_quarantine` instead."""
    c = _loyalty_checks(raw)
    ok = c.filter(F.col("__ts").isNotNull() & F.col("__pts").isNotNull() & F.col("__meta_ok"))
    return ok.select(F.col("__ts").alias("event_ts"), "member_id", "event_type", F.col("__pts").alias("points"),
                     "store_id", "tx_id", F.expr("str_to_map(meta_raw, ';', '=')").alias("meta"), "date_ts")


def loyalty_quarantine(raw: DataFrame) -> DataFrame:
    c = _loyalty_checks(raw)
    reason = F.concat_ws(",", F.when(F.col("__ts").isNull(), F.lit("bad_ts")),
                         F.when(F.col("__pts").isNull(), F.lit("bad_points")),
                         F.when(~F.col("__meta_ok"), F.lit("bad_meta")))
    bad = c.filter(F.col("__ts").isNull() | F.col("__pts").isNull() | ~F.col("__meta_ok"))
    return bad.select(*raw.columns, reason.alias("reject_reason"))


# S10 / A7 -------------------------------------------------------------------
def warehouse_kpi_snapshot(picks: DataFrame, movements: DataFrame) -> DataFrame:
    """Per warehouse and hour: units in / shipped (movements IN / OUT),
    units picked, pick rate per hour, backlog = running (in - shipped) per
    warehouse, mean pick time (ms, integer division)."""
    hour = lambda c: F.date_trunc("hour", F.col(c)).cast("timestamp_ntz")
    m = movements.groupBy("warehouse_id", hour("movement_ts").alias("snapshot_ts")).agg(
        F.sum(F.when(F.col("movement_type") == "IN", F.col("quantity"))).alias("__in"),
        F.sum(F.when(F.col("movement_type") == "OUT", F.col("quantity"))).alias("__out"))
    p = picks.groupBy("warehouse_id", hour("picked_at").alias("snapshot_ts")).agg(
        F.sum("quantity").alias("__picked"), F.sum("duration_ms").alias("__ms"), F.count(F.lit(1)).alias("__n"))
    j = m.join(p, ["warehouse_id", "snapshot_ts"], "full_outer")
    j = j.select("warehouse_id", "snapshot_ts",
                 F.coalesce("__in", F.lit(0)).alias("units_in"), F.coalesce("__picked", F.lit(0)).alias("units_picked"),
                 F.coalesce("__out", F.lit(0)).alias("units_shipped"), "__ms", "__n")
    j = running_sum(j, ["warehouse_id"], ["snapshot_ts"], F.col("units_in") - F.col("units_shipped"), "backlog_units")
    return j.select("warehouse_id", "snapshot_ts", "units_in", "units_picked", "units_shipped",
                    F.col("units_picked").cast("decimal(8,2)").alias("pick_rate_uph"), "backlog_units",
                    F.expr("__ms div __n").alias("avg_pick_ms"),
                    F.date_format("snapshot_ts", "yyyyMMdd").alias("date_ts"),
                    "__ms", "__n")


def hourly_warehouse_kpi(snapshot: DataFrame) -> DataFrame:
    """A7 from S10: numeric warehouse key, 'yyyyMMdd_HH' hour text and the
    partition date parsed back from it."""
    hour_txt = F.date_format("snapshot_ts", "yyyyMMdd_HH")
    return snapshot.select(
        F.substring("warehouse_id", 3, 10).cast("bigint").alias("warehouse_sk"),
        "units_in", "units_picked", "units_shipped", "pick_rate_uph", "backlog_units",
        decimal_ratio(F.col("__ms"), F.col("__n") * 1000, 8, 2).alias("avg_pick_seconds"),
        hour_txt.alias("snapshot_hour"),
        F.to_date(F.to_timestamp_ntz(hour_txt, F.lit("yyyyMMdd_HH"))).alias("_partition_date"))


def kpi_snapshot_table(snapshot: DataFrame) -> DataFrame:
    return snapshot.drop("__ms", "__n")
