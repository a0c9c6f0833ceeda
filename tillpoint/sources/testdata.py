"""Retail tables derived from the driver's TPC-H-like parquet tables.

The reference declares retail schemas but ships no data.  These builders
turn the given tables (lineitem, orders, customer, nation, region, supplier,
part, events) into the retail inputs the views read, following FIXTURES.md.
All of them are lazy DataFrames, so a view over them is one Spark plan and
Catalyst prunes columns and pushes filters down into the parquet scans.

Money is carried as DECIMAL computed from exact cents, never from float
products, so results do not depend on summation order.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import lookup_join

# As-of dates per data domain (the driver's data is historical, so
# "CURRENT_DATE()" is pinned to the last day of each domain).
SALES_AS_OF = dt.date(2001, 8, 1)      # last order date
EVENTS_AS_OF = dt.date(2024, 1, 31)    # day after the last event
SHIP_AS_OF = dt.date(2001, 11, 4)      # last ship date
RETURNS_AS_OF = dt.date(2001, 12, 31)  # after the last return request

CALENDAR_START = dt.date(1995, 1, 1)
CALENDAR_END = dt.date(2002, 12, 31)

# Country spelling per nation key, as written on sales lines
# and on the customer record.  Nations not listed keep n_name on sales and a
# lower-cased n_name on even-keyed customers, so U1 has work to do.
NATION_SPELLINGS = {
    0: ("Germany", "DE"),
    1: ("UK", "United Kingdom"),
    2: ("USA", " united states "),
    3: ("France", "FR"),
    4: ("Japan", "jp"),
    5: ("Australia", "AU"),
    6: ("Canada", "ca"),
    7: ("England", "GB"),
    8: ("Deutschland", "germany\t"),
    9: ("United States of America", "US\u00a0"),
    10: ("Great Britain", "uk"),
}

# Carrier names by l_suppkey % 5; referrer URLs by k % 4
# (k % 4 = 3 has no referrer).
CARRIERS = ["UPS", "FEDEX", "DHL", "USPS", "ONTRAC"]
REFERRERS = ["https://search.example.com/", "https://mail.example.com/",
             "https://social.example.com/"]
CHANGE_OPS = {"error": "D", "signup": "I"}  # anything else is 'U'


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: Column, mapping: dict, default: Column | None = None) -> Column:
    items = list(mapping.items())
    expr = F.when(key == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(key == F.lit(k), F.lit(v))
    return expr.otherwise(default) if default is not None else expr


def _pick(idx: Column, values: list[str]) -> Column:
    return _case(idx, dict(enumerate(values)))


def _props_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def _cents_to_decimal(cents: Column, precision: int) -> Column:
    return (cents.cast("decimal(18,0)") / F.lit(100)).cast(f"decimal({precision},2)")


# ---------------------------------------------------------------- sales ----

def nation_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> (sales spelling, customer spelling).  25 rows: bounded."""
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    key = F.col("n_nationkey")
    sales = _case(key, {k: v[0] for k, v in NATION_SPELLINGS.items()}, F.col("n_name"))
    cust_default = F.when(key % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    cust = _case(key, {k: v[1] for k, v in NATION_SPELLINGS.items()}, cust_default)
    return n.select("n_nationkey", "n_name", "n_regionkey",
                    sales.alias("sales_country"), cust.alias("customer_country"))


def fact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_sales: one row per line item (F1 contract, plus store_sk for D2)."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(nation_countries(spark, sf_dir).select("n_nationkey", "sales_country"))
    cust = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "sales_country")
    oc = lookup_join(o, cust, "o_custkey", "c_custkey", "left")  # a customer may hold a third of the orders
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    qty = F.col("l_quantity").cast("bigint")
    # one row per order: hashed, so the lines need no sort
    return li.join(oc.hint("shuffle_hash"), li.l_orderkey == oc.o_orderkey).select(
        F.col("l_orderkey").cast("string").alias("invoice_no"),
        F.col("o_custkey").alias("customer_sk"),
        F.col("l_partkey").alias("product_sk"),
        qty.alias("quantity"),
        (price / qty.cast("decimal(10,0)")).cast("decimal(10,2)").alias("unit_price"),
        (price * (F.lit(1) - disc)).cast("decimal(14,2)").alias("line_total"),
        F.col("sales_country").alias("country"),
        F.col("o_orderdate").alias("invoice_ts"),
        F.to_date("o_orderdate").alias("sale_date"),
        F.col("l_suppkey").alias("store_sk"),
    )


def dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(nation_countries(spark, sf_dir).select("n_nationkey", "customer_country"))
    key = F.col("c_custkey")
    country = (F.when(key % 13 == 0, F.lit(None).cast("string"))
               .when(key % 29 == 0, F.lit("Atlantis"))
               .otherwise(F.col("customer_country")))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        key.alias("customer_sk"), key.cast("string").alias("customer_id"), country.alias("country"))


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_sk"),
        F.concat(F.lit("SKU"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("stock_code"),
        F.col("p_name").alias("description"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"),
    )


def dim_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores are the suppliers; region = r_name through nation."""
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey))
    return s.join(nr, s.s_nationkey == nr.n_nationkey, "left").select(
        F.col("s_suppkey").alias("store_sk"),
        F.concat(F.lit("ST"), F.col("s_suppkey").cast("string")).alias("store_id"),
        F.col("s_name").alias("store_name"),
        _pick(F.col("s_suppkey") % 3, ["flagship", "mall", "outlet"]).alias("store_type"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("country"),
    )


def dim_date(spark: SparkSession, start: dt.date = CALENDAR_START,
             end: dt.date = CALENDAR_END) -> DataFrame:
    """Calendar dimension (D1 subset used by V2).  Weeks start on Sunday;
    ``d_week_seq`` counts weeks from 1899-12-31.  Bounded: one row per day."""
    days = (end - start).days + 1
    d = F.date_add(F.lit(start), F.col("id").cast("int"))
    base = spark.range(0, days, numPartitions=1).select(d.alias("d_date"))
    return base.select(
        (F.datediff("d_date", F.lit(dt.date(1900, 1, 1))) + F.lit(2415021)).cast("bigint").alias("d_date_sk"),
        "d_date",
        (F.floor(F.datediff("d_date", F.lit(dt.date(1899, 12, 31))) / 7) + 1).cast("bigint").alias("d_week_seq"),
        F.year("d_date").cast("bigint").alias("d_year"),
    )


# --------------------------------------------------------------- events ----

def mobile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw.mobile_events from click/view events (schema of appendix A)."""
    e = _read(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    k = _props_k(F.col("props"))
    uid = F.col("user_id")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("event_ts"),
        uid.cast("string").alias("user_id"),
        F.concat(F.lit("5."), (uid % 4).cast("string")).alias("app_version"),
        _pick(uid % 3, ["phone", "tablet", "desktop"]).alias("device_type"),
        _pick(uid % 2, ["ios", "android"]).alias("platform"),
        F.create_map(F.lit("k"), k.cast("string"), F.lit("event_type"), F.col("event_type")).alias("properties"),
        F.struct(
            F.concat_ws(".", F.lit("10.0"), (uid % 250).cast("string"), (F.col("event_id") % 250).cast("string")).alias("ip"),
            F.lit("US").alias("country"),
            F.concat_ws("-", uid.cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
            _pick(k % 4, REFERRERS).alias("referrer"),
        ).alias("context"),
        F.array(F.struct(
            F.concat(F.lit("SKU"), k.cast("string")).alias("sku"),
            (F.lit(1) + k % 3).alias("qty"),
            F.col("value").cast("decimal(10,2)").alias("price"),
        )).alias("items"),
        F.date_format("ts", "yyyy-MM-dd").alias("event_date"),
        F.hour("ts").cast("bigint").alias("hour_bucket"),
    )


def app_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale lines from 'purchase' events (the orders V6 attributes to app
    sessions; the TPC-H orders end in 2001, the events are from 2024)."""
    e = _read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    k = _props_k(F.col("props"))
    value = F.col("value").cast("decimal(14,2)")
    return e.select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("invoice_no"),
        F.col("user_id").alias("customer_sk"),
        k.alias("product_sk"),
        F.lit(1).cast("bigint").alias("quantity"),
        value.cast("decimal(10,2)").alias("unit_price"),
        value.alias("line_total"),
        F.lit(None).cast("string").alias("country"),
        F.col("ts").alias("invoice_ts"),
        F.to_date("ts").alias("sale_date"),
        (F.col("user_id") % 10).alias("store_sk"),
    )


def fact_loyalty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase"))
    return e.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("member_id"),
        F.when(F.col("event_type") == "click", F.lit("REDEEM")).otherwise(F.lit("EARN")).alias("event_type"),
        F.floor("value").cast("bigint").alias("points"),
        (F.col("user_id") % 10).alias("store_sk"),
        F.col("event_id").cast("string").alias("tx_id"),
        F.col("ts").alias("event_ts"),
        F.create_map(F.lit("k"), _props_k(F.col("props")).cast("string")).alias("meta"),
        F.to_date("ts").alias("event_date"),
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a keyed change feed: key = user_id, ordered by ts (unique
    per user); 'error' -> D, 'signup' -> I, else U."""
    e = _read(spark, sf_dir, "events")
    k = _props_k(F.col("props"))
    return e.select(
        F.col("user_id").alias("return_id"),
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("invoice_no"),
        F.col("user_id").alias("customer_sk"),
        F.col("ts").alias("return_ts"),
        F.col("value").cast("decimal(12,2)").alias("refund_amount"),
        F.concat(F.lit("R"), (k % 5).cast("string")).alias("reason_code"),
        F.col("event_type").alias("status"),
        _case(F.col("event_type"), CHANGE_OPS, F.lit("U")).alias("op"),
        F.to_date("ts").alias("snapshot_date"),
        F.col("event_id"),
        k.alias("k"),
    )


def fraud_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw.fraud_signals from 'error' events; signal_date is yyyyMMdd text."""
    e = _read(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = _props_k(F.col("props"))
    return e.select(
        F.col("user_id").cast("string").alias("customer_id"),
        _pick(k % 3, ["velocity", "device", "geo"]).alias("signal_type"),
        (k.cast("double") / 100.0).alias("score"),
        F.when(k >= 70, "HIGH").when(k >= 40, "MEDIUM").otherwise("LOW").alias("risk_band"),
        F.array(F.concat(F.lit("RC"), (k % 5).cast("string")),
                F.concat(F.lit("RC"), (k % 3).cast("string"))).alias("reason_codes"),
        F.col("ts").cast("timestamp").alias("signal_ts"),
        _pick(F.col("user_id") % 2, ["vendor_a", "vendor_b"]).alias("vendor"),
        F.date_format("ts", "yyyyMMdd").alias("signal_date"),
        F.to_date("ts").alias("_ingest_date"),
    )


# Positions of the named columns in the 60-column landing.
OMNITURE_POSITIONS = {2: "event_ts", 8: "ip", 13: "url", 14: "user_id",
                      50: "city", 51: "country", 53: "state"}


def omniture_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw.omniture_logs: 60 untyped string columns from all events."""
    e = _read(spark, sf_dir, "events")
    k = _props_k(F.col("props"))
    uid = F.col("user_id")
    named = {
        2: F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        8: F.concat_ws(".", F.lit("10.1"), (uid % 250).cast("string"), (F.col("event_id") % 250).cast("string")),
        13: F.concat(F.lit("/p/"), k.cast("string")),
        14: uid.cast("string"),
        50: F.concat(F.lit("City"), (uid % 20).cast("string")),
        51: _pick(uid % 3, ["US", "GB", "DE"]),
        53: F.concat(F.lit("S"), (uid % 7).cast("string")),
        1: F.col("event_id").cast("string"),
        3: F.col("event_type"),
    }
    cols = [named.get(i, F.lit(None).cast("string")).alias(f"col_{i}") for i in range(1, 61)]
    return e.select(*cols, F.date_format("ts", "yyyyMMdd").alias("date_ts"))


# ------------------------------------------------------------ lineitem ----

def fact_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    delivered = F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
        F.timestamp_add("HOUR", (F.col("l_partkey") % 96).cast("int"), F.col("l_shipdate")))
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("shipment_id"),
        F.col("l_orderkey").cast("string").alias("invoice_no"),
        (F.col("l_suppkey") % 7).alias("warehouse_sk"),
        _pick(F.col("l_suppkey") % 5, CARRIERS).alias("carrier"),
        F.concat(F.lit("TRK"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("tracking_no"),
        F.col("l_shipdate").alias("shipped_ts"),
        delivered.alias("delivered_ts"),
        F.lit(48).cast("bigint").alias("sla_hours"),
        F.to_date("l_shipdate").alias("_partition_date"),
    )


def fact_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items flagged 'R' are returns; returned (l_partkey % 30) days
    after shipping."""
    li = _read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    ts = F.timestamp_add("DAY", (F.col("l_partkey") % 30).cast("int"), F.col("l_shipdate"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("invoice_no"),
        F.col("l_partkey").alias("product_sk"),
        F.col("l_suppkey").alias("store_sk"),
        ts.alias("return_ts"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (price * (F.lit(1) - disc)).cast("decimal(12,2)").alias("refund_amount"),
        F.concat(F.lit("R"), (F.col("l_partkey") % 5).cast("string")).alias("reason_code"),
        F.to_date(ts).alias("return_date"),
    )


def return_authorizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    requested = F.timestamp_add(
        "HOUR", (F.col("l_suppkey") % 24).cast("int"),
        F.timestamp_add("DAY", (F.col("l_partkey") % 30).cast("int"), F.col("l_shipdate")))
    approved = (F.when(F.col("l_partkey") % 3 == 0, F.lit(None).cast("boolean"))
                .when(F.col("l_partkey") % 3 == 1, F.lit(False)).otherwise(F.lit(True)))
    return li.join(o, li.l_orderkey == o.o_orderkey, "left").select(
        F.concat_ws("-", F.lit("RMA"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("rma_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_orderkey").cast("string").alias("invoice_no"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.concat(F.lit("R"), (F.col("l_partkey") % 5).cast("string")).alias("reason_code"),
        requested.alias("requested_at"),
        approved.alias("approved"),
    )


def dim_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category tree: regions (roots; parent NULL and '' alternately) ->
    nations -> suppliers."""
    r = _read(spark, sf_dir, "region")
    n = _read(spark, sf_dir, "nation")
    s = _read(spark, sf_dir, "supplier")
    roots = r.select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("category_id"),
        F.when(F.col("r_regionkey") % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("")).alias("parent_id"),
        F.col("r_name").alias("name"), F.lit(0).cast("bigint").alias("depth"))
    mids = n.select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")),
        F.col("n_name"), F.lit(1).cast("bigint"))
    leaves = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")),
        F.col("s_name"), F.lit(2).cast("bigint"))
    return reduce(DataFrame.union, [roots, mids, leaves])


def product_supplier_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier offers per product: every (part, supplier) pair that occurs
    on a line item, priced at 40-59 % of the retail price."""
    pairs = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    pct = (F.lit(40) + F.col("l_suppkey") % 20).cast("decimal(4,0)")
    cost = (F.col("p_retailprice").cast("decimal(12,2)") * pct / F.lit(100)).cast("decimal(12,4)")
    return pairs.join(p, pairs.l_partkey == p.p_partkey).select(
        F.col("l_partkey").alias("product_sk"),
        F.col("l_suppkey").alias("supplier_sk"),
        F.concat(F.lit("SUP"), F.col("l_suppkey").cast("string"), F.lit("-"),
                 F.col("l_partkey").cast("string")).alias("supplier_sku"),
        cost.alias("unit_cost"),
        (F.lit(1) + (F.col("l_partkey") + F.col("l_suppkey")) % 14).alias("lead_time_days"),
        (F.lit(10) * (F.lit(1) + F.col("l_suppkey") % 5)).alias("moq"),
        F.lit(CALENDAR_START).alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
    )


# ------------------------------------------------------- keyed feeds ----
# Events re-read as keyed change feeds for the state jobs (C*, K*).
FEED_SPLIT = dt.datetime(2024, 1, 15)   # batch 1 < split <= batch 2
ADJUST_REASONS = ["DAMAGE", "COUNT", "THEFT", "RETURN"]


def _events_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").withColumn("k", _props_k(F.col("props")))


def _epoch_ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def address_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_k(spark, sf_dir)
    uid = F.col("user_id")
    return e.select(
        uid.alias("customer_sk"),
        F.concat(F.lit("Street "), (F.col("k") % 2).cast("string")).alias("address_line1"),
        F.concat(F.lit("City"), (F.col("k") % 3).cast("string")).alias("address_city"),
        F.concat(F.lit("R"), (uid % 4).cast("string")).alias("address_region"),
        _pick(uid % 3, ["US", "GB", "DE"]).alias("address_country"),
        F.lpad((uid % 1000).cast("string"), 5, "0").alias("address_postal"),
        F.col("ts"))


def inventory_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_k(spark, sf_dir)
    return e.select(
        F.concat(F.lit("WH"), (F.col("user_id") % 7).cast("string")).alias("warehouse_id"),
        F.concat(F.lit("SKU"), (F.col("k") % 20).cast("string")).alias("sku"),
        F.floor("value").cast("bigint").alias("on_hand"),
        (F.col("k") % 10).alias("allocated"),
        _epoch_ms(F.col("ts")).alias("last_updated_ts"),
        F.col("ts"))


def price_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_k(spark, sf_dir).filter(F.col("event_type").isin("purchase", "view"))
    price = F.col("value").cast("decimal(10,2)")
    return e.select(
        F.concat(F.lit("SKU"), (F.col("k") % 20).cast("string")).alias("sku"),
        F.concat(F.lit("ST"), (F.col("user_id") % 10).cast("string")).alias("store_id"),
        price.alias("price"),
        (price * F.lit(1.25).cast("decimal(3,2)")).cast("decimal(10,2)").alias("list_price"),
        (price * F.lit(0.6).cast("decimal(2,1)")).cast("decimal(10,2)").alias("cost"),
        _epoch_ms(F.col("ts")).alias("updated_ts"),
        F.lit("rules").alias("pricing_engine"),
        F.col("ts"))


def promo_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_k(spark, sf_dir)
    return e.select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.concat(F.lit("P"), (F.col("k") % 3).cast("string")).alias("promo_id"),
        (F.col("event_type") != "error").alias("eligible"),
        F.col("event_type").alias("eligibility_reason"),
        _epoch_ms(F.col("ts")).alias("valid_from_ts"),
        _epoch_ms(F.timestamp_add("DAY", F.lit(7), F.col("ts"))).alias("valid_to_ts"),
        (F.col("event_type") == "purchase").alias("redeemed"),
        F.col("ts"))


def inventory_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_k(spark, sf_dir).filter(F.col("event_type").isin("error", "signup", "view"))
    k, uid = F.col("k"), F.col("user_id")
    pending = k % 10 == 0
    return e.select(
        F.col("event_id").alias("adjustment_id"),
        (uid % 7).alias("warehouse_sk"),
        F.concat(F.lit("SKU"), (k % 20).cast("string")).alias("sku"),
        (k - 50).alias("quantity_delta"),
        _pick(k % 4, ADJUST_REASONS).alias("reason_code"),
        F.lit(None).cast("string").alias("notes"),
        F.concat(F.lit("EMP"), (uid % 13).cast("string")).alias("adjusted_by"),
        F.col("ts").alias("adjusted_at"),
        F.when(pending, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("EMP"), ((uid + k) % 13).cast("string"))).alias("approved_by"),
        F.when(pending, F.lit(None).cast("timestamp_ntz")).otherwise(
            F.timestamp_add("MINUTE", k.cast("int"), F.col("ts"))).alias("approved_at"))


# ------------------------------------------------------------ raw feeds ----
# Landing-zone tables (raw layer) derived from the driver's tables, with the
# dirt the staging jobs exist to clean.
TENDERS = ["CASH", "CARD", "GIFT"]
STAGING_AS_OF = dt.date(2001, 8, 1)


def pos_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    gross = F.col("o_totalprice").cast("decimal(14,2)")
    return o.select(
        key.alias("txn_id"),
        F.concat(F.lit("ST"), (F.col("o_custkey") % 10).cast("string")).alias("store_id"),
        F.concat(F.lit("REG"), (key % 4).cast("string")).alias("register_id"),
        F.concat(F.lit("EMP"), (key % 13).cast("string")).alias("cashier_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        key.cast("string").alias("invoice_no"),
        F.col("o_orderdate").alias("txn_ts"),
        (key % 7 + 1).alias("line_count"),
        gross.alias("gross_amount"),
        (gross * (key % 5).cast("decimal(2,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(14,2)").alias("discount_amount"),
        (gross * F.lit(0.08).cast("decimal(3,2)")).cast("decimal(14,2)").alias("tax_amount"),
        _pick(key % 3, TENDERS).alias("tender_type"),
        F.when(key % 23 == 0, F.lit(None).cast("boolean")).otherwise(key % 17 == 0).alias("void_flag"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("date_ts"))


def product_catalog_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feed deliveries per part (the later one re-prices and re-spells)."""
    p = _read(spark, sf_dir, "part").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    later = F.col("v") == 1
    price = F.col("p_retailprice").cast("decimal(10,2)")
    return p.select(
        F.concat(F.lit("SKU"), F.col("p_partkey").cast("string")).alias("sku"),
        F.concat(F.lit("SUP"), (F.col("p_partkey") % 50).cast("string")).alias("supplier_id"),
        F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("upc"),
        F.when(later, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).otherwise(F.upper("p_name")).alias("name"),
        F.when(later, F.lower("p_type")).otherwise(F.col("p_type")).alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.when(later, F.upper(F.split("p_name", " ").getItem(0))).otherwise(F.split("p_name", " ").getItem(0)).alias("color"),
        F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("size"),
        F.when(later, (price * F.lit(1.05).cast("decimal(3,2)")).cast("decimal(10,2)")).otherwise(price).alias("msrp"),
        (price * F.lit(0.5).cast("decimal(2,1)")).cast("decimal(10,2)").alias("cost"),
        F.date_add(F.lit(CALENDAR_START), (F.col("p_partkey") % 4000).cast("int")).alias("available_from"),
        F.when(F.col("p_partkey") % 9 == 0, F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("p_partkey") % 900).cast("int")))
        .alias("discontinued_at"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("metadata"),
        F.when(later, F.lit("20010201")).otherwise(F.lit("20010101")).alias("feed_date"))


def shipment_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    sh = fact_shipments(spark, sf_dir)
    supp = F.col("warehouse_sk")
    status = F.when(F.col("delivered_ts").isNull(), F.lit("in_transit")).otherwise(F.lit("delivered"))
    return sh.select(
        "tracking_no",
        F.when(supp % 2 == 0, F.lower("carrier")).otherwise(F.col("carrier")).alias("carrier"),
        "invoice_no",
        F.lit(None).cast("string").alias("customer_id"),
        F.col("shipped_ts").alias("shipped_at"), F.col("delivered_ts").alias("delivered_at"),
        status.alias("status"),
        F.concat(F.lit("City"), supp.cast("string"), F.lit(", R"), (supp % 3).cast("string"),
                 F.lit(" ,"), _pick(supp % 3, ["US", "GB", "DE"])).alias("last_location"),
        F.timestamp_add("HOUR", F.lit(48), F.col("shipped_ts")).alias("estimated_eta"),
        F.date_format("shipped_ts", "yyyyMMdd").alias("date_ts"),
        F.col("carrier").alias("carrier_partition"))


def loyalty_events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw.loyalty_events: everything STRING, some rows malformed."""
    e = _events_k(spark, sf_dir).filter(F.col("event_type").isin("click", "purchase"))
    k = F.col("k")
    return e.select(
        F.when(k % 17 == 0, F.lit("not-a-date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("event_ts_str"),
        F.col("user_id").cast("string").alias("member_id"),
        F.when(F.col("event_type") == "click", F.lit("REDEEM")).otherwise(F.lit("EARN")).alias("event_type"),
        F.when(k % 13 == 0, F.lit("N/A")).otherwise(F.floor("value").cast("string")).alias("points"),
        F.concat(F.lit("ST"), (F.col("user_id") % 10).cast("string")).alias("store_id"),
        F.col("event_id").cast("string").alias("tx_id"),
        F.when(k % 11 == 0, F.lit("garbage")).otherwise(
            F.concat(F.lit("k="), k.cast("string"), F.lit(";src=app"))).alias("meta_raw"),
        F.date_format("ts", "yyyyMMdd").alias("date_ts"))


def warehouse_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    wh = F.concat(F.lit("WH"), (F.col("l_suppkey") % 7).cast("string"))
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pick_id"),
        wh.alias("warehouse_id"), F.concat(F.lit("BIN"), (F.col("l_partkey") % 40).cast("string")).alias("bin_id"),
        F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("sku"),
        F.concat(F.lit("EMP"), (F.col("l_orderkey") % 13).cast("string")).alias("picker_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.timestamp_add("HOUR", (F.col("l_suppkey") % 24).cast("int"), F.col("l_shipdate")).alias("picked_at"),
        (F.lit(20000) + (F.col("l_partkey") % 97) * 1000).cast("bigint").alias("duration_ms"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("date_ts"), wh.alias("warehouse_id_partition"))


def inventory_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    ts = F.timestamp_add("HOUR", (F.col("l_partkey") % 24).cast("int"), F.col("l_shipdate"))
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("movement_id"),
        F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("sku"),
        F.concat(F.lit("WH"), (F.col("l_suppkey") % 7).cast("string")).alias("warehouse_id"),
        F.concat(F.lit("BIN"), (F.col("l_partkey") % 40).cast("string")).alias("bin_location"),
        F.when(F.col("l_linestatus") == "O", F.lit("IN")).otherwise(F.lit("OUT")).alias("movement_type"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        ts.alias("movement_ts"),
        F.col("l_orderkey").cast("string").alias("reference_doc"),
        F.concat(F.lit("EMP"), (F.col("l_suppkey") % 13).cast("string")).alias("operator_id"),
        F.lit(None).cast("string").alias("reason_code"),
        F.year(ts).cast("bigint").alias("year"), F.month(ts).cast("bigint").alias("month"),
        F.dayofmonth(ts).cast("bigint").alias("day"))


# Movement types of the costed movements, by line.
MOVEMENT_TYPES = ["IN", "OUT", "IN", "ALLOCATE", "DISPATCH", "IN", "RELEASE", "OUT", "ARRIVE", "ADJUST", "COUNT"]


def costed_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory movements of all types with a unit cost (price per unit of
    the line, in cents); adjustments of odd orders are negative."""
    li = _read(spark, sf_dir, "lineitem")
    kind = _pick((F.col("l_orderkey") + F.col("l_linenumber")) % len(MOVEMENT_TYPES), MOVEMENT_TYPES)
    sign = F.when((kind == "ADJUST") & (F.col("l_orderkey") % 2 == 1), -1).otherwise(1)
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("movement_id"),
        F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("sku"),
        F.concat(F.lit("WH"), (F.col("l_suppkey") % 7).cast("string")).alias("warehouse_id"),
        kind.alias("movement_type"), (sign * F.col("l_quantity").cast("bigint")).alias("quantity"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("bigint")).cast("decimal(12,4)").alias("unit_cost"),
        F.timestamp_add("HOUR", (F.col("l_partkey") % 24).cast("int"), F.col("l_shipdate")).alias("movement_ts"))


def customer_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.cast("string").alias("customer_id"),
        F.concat(F.lit("Street "), (key % 97).cast("string")).alias("addr_line1"),
        F.concat(F.lit("City"), (key % 50).cast("string")).alias("addr_city"),
        F.concat(F.lit("R"), (key % 4).cast("string")).alias("addr_region"),
        _pick(F.col("c_nationkey") % 3, ["US", "GB", "DE"]).alias("addr_country"),
        F.lpad((key % 500).cast("string"), 5, "0").alias("addr_postal"))


def dim_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known places: postal-level entries for most postcodes in use and
    city-level entries (postal NULL) for most cities in use."""
    a = customer_addresses(spark, sf_dir)
    pc = F.col("addr_postal").cast("int")
    postal = a.filter(pc % 4 != 0).select("addr_country", "addr_postal").distinct().select(
        F.col("addr_country").alias("country_iso2"), F.lit(None).cast("string").alias("city"),
        F.col("addr_postal").alias("postal_code"),
        (F.col("addr_postal").cast("int") % 180 - 90).cast("double").alias("latitude"),
        (F.col("addr_postal").cast("int") % 360 - 180).cast("double").alias("longitude"))
    cn = F.substring("addr_city", 5, 3).cast("int")
    city = a.filter(cn % 5 != 0).select("addr_country", "addr_city").distinct().select(
        F.col("addr_country").alias("country_iso2"), F.col("addr_city").alias("city"),
        F.lit(None).cast("string").alias("postal_code"),
        (F.substring("addr_city", 5, 3).cast("int") - 45).cast("double").alias("latitude"),
        (F.substring("addr_city", 5, 3).cast("int") * 3).cast("double").alias("longitude"))
    return postal.unionByName(city)


def customer_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw.customer_signups: every customer once, every fifth twice (a later
    re-signup); messy e-mail and phone text."""
    a = customer_addresses(spark, sf_dir)
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    x = a.join(c, a.customer_id == c.c_custkey.cast("string"))
    x = x.withColumn("v", F.explode(F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit(0), F.lit(1)))
                                    .otherwise(F.array(F.lit(0)))))
    key = F.col("c_custkey")
    return x.select(
        "customer_id",
        F.concat(F.lit(" "), F.col("c_name"), F.when(F.col("v") == 1, F.lit("@New.Example.COM ")).otherwise(F.lit("@Example.COM"))).alias("email"),
        F.concat(F.lit("(555) "), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("-"),
                 F.lpad((key % 10000).cast("string"), 4, "0")).alias("phone"),
        F.lit("Pat").alias("first_name"), F.col("c_name").alias("last_name"),
        "addr_line1", "addr_city", "addr_region", "addr_country", "addr_postal",
        F.col("c_mktsegment").alias("signup_source"), (key % 2 == 0).alias("marketing_opt_in"),
        F.date_format(F.date_add(F.lit(dt.date(1998, 1, 1)), (key % 700 + F.col("v") * 400).cast("int")), "yyyyMMdd").alias("signup_date"))


def sales_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw.sales_retail (CSV landing): text invoice dates in two formats,
    natural keys only."""
    fs = fact_sales(spark, sf_dir)
    even = F.col("invoice_no").cast("bigint") % 2 == 0
    return fs.select(
        "invoice_no",
        F.concat(F.lit("SKU"), F.lpad(F.col("product_sk").cast("string"), 7, "0")).alias("stock_code"),
        F.lit(None).cast("string").alias("description"),
        "quantity",
        F.when(even, F.date_format("invoice_ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("invoice_ts", "MM/dd/yyyy HH:mm")).alias("invoice_date"),
        "unit_price",
        F.col("customer_sk").cast("string").alias("customer_id"),
        "country",
        F.date_format("invoice_ts", "yyyyMMdd").alias("date_ts"))


def supplier_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw.supplier_invoices: one invoice per (order, supplier) with its
    lines as ARRAY<STRUCT<sku, qty, unit_price>>."""
    li = _read(spark, sf_dir, "lineitem")
    price = (F.col("l_extendedprice").cast("decimal(15,2)") / F.col("l_quantity").cast("decimal(10,0)")).cast("decimal(10,2)")
    g = li.groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_shipdate").alias("d"),
        F.array_sort(F.collect_list(F.struct(
            F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("sku"),
            F.col("l_quantity").cast("bigint").alias("qty"), price.alias("unit_price")))).alias("line_items"))
    return g.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("invoice_no"),
        F.concat(F.lit("SUP"), F.col("l_suppkey").cast("string")).alias("supplier_id"),
        F.to_date("d").alias("invoice_date"), F.date_add(F.to_date("d"), 30).alias("due_date"),
        F.lit(None).cast("decimal(14,2)").alias("total_amount"), F.lit("USD").alias("currency"),
        "line_items", F.lit(None).cast("string").alias("raw_xml"),
        F.year("d").cast("bigint").alias("feed_year"), F.month("d").cast("bigint").alias("feed_month"))


def email_campaign_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_k(spark, sf_dir).filter(F.col("event_type") == "click")
    k = F.col("k")
    return e.select(
        F.concat(F.lit("CMP"), (k % 5).cast("string")).alias("campaign_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), (k % 5).cast("string"),
                    F.date_format("ts", "yyyyMMdd")).alias("send_id"),
        F.col("user_id").cast("string").alias("recipient"),
        F.col("ts").alias("clicked_at"),
        F.concat(F.lit("/c/"), k.cast("string")).alias("click_url"))


def supplier_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items seen from the supplier side: what was received when."""
    li = _read(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    delivered = F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
        F.timestamp_add("HOUR", (F.col("l_partkey") % 96).cast("int"), F.col("l_shipdate")))
    return li.select(F.col("l_suppkey").alias("supplier_sk"), "l_orderkey",
                     F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_shipdate").alias("shipped_ts"),
                     delivered.alias("delivered_ts"), "l_linestatus", "l_returnflag",
                     (price * (F.lit(1) - disc)).cast("decimal(14,2)").alias("line_total"))


EMPLOYEE_ROLES = ["CASHIER", "SUPERVISOR", "STOCK"]
DEPARTMENTS = ["FRONT", "BACK", "OFFICE"]


def employee_year_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attribute snapshot per cashier and year worked (from the POS
    feed): role and band rotate by year, department by store."""
    p = pos_transactions(spark, sf_dir)
    y = F.year("txn_ts")
    g = p.groupBy("cashier_id", y.alias("yr")).agg(F.min("store_id").alias("store_id"),
                                                   F.count(F.lit(1)).alias("txns"))
    n = F.substring("cashier_id", 4, 10).cast("bigint")
    return g.select(
        n.alias("employee_sk"), "yr", "txns",
        _pick((n + F.col("yr")) % 3, EMPLOYEE_ROLES).alias("role"),
        _pick(F.substring("store_id", 3, 10).cast("int") % 3, DEPARTMENTS).alias("department"),
        F.substring("store_id", 3, 10).cast("bigint").alias("home_store_sk"),
        F.concat(F.lit("B"), ((F.col("yr") - n) % 2 + 1).cast("string")).alias("salary_band"),
        F.make_date(F.col("yr").cast("int"), F.lit(1), F.lit(1)).alias("eff_date"))


def supplier_terms_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment terms per supplier and month of shipments (terms rotate by
    quarter, the discount by half-year)."""
    li = _read(spark, sf_dir, "lineitem")
    m = F.trunc("l_shipdate", "month")
    g = li.groupBy(F.col("l_suppkey").alias("supplier_sk"), m.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    q = F.quarter("m")
    return g.select(
        "supplier_sk",
        (F.lit(30) + ((F.col("supplier_sk") + q) % 3) * 15).cast("bigint").alias("payment_terms_days"),
        ((F.col("supplier_sk") + F.floor((F.month("m") - 1) / 6)) % 4).cast("decimal(5,2)").alias("discount_pct"),
        F.col("m").cast("timestamp_ntz").alias("eff_ts"),
        F.concat(F.lit("EMP"), (F.col("supplier_sk") % 13).cast("string")).alias("changed_by"))


def store_month_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store attributes per store and month of POS activity."""
    p = pos_transactions(spark, sf_dir)
    m = F.trunc("txn_ts", "month")
    g = p.groupBy(F.substring("store_id", 3, 10).cast("bigint").alias("store_sk"), m.alias("m")).agg(
        F.min("cashier_id").alias("mgr"))
    return g.select(
        "store_sk", _pick((F.col("store_sk") + F.year("m")) % 3, ["flagship", "mall", "outlet"]).alias("store_type"),
        F.substring("mgr", 4, 10).cast("bigint").alias("manager_employee_sk"),
        (F.lit(1000) + (F.col("store_sk") % 5) * 500 + (F.year("m") % 2) * 250).cast("bigint").alias("sq_ft"),
        F.col("m").alias("eff_date"))
