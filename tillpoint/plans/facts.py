"""F1-F10 fact loads, D1-D3 dimensions, B3/B4 bridges.

A fact load is: natural keys -> surrogate keys by lookup joins, typing to
the target schema, derived partition columns.  Dimension keys come from
:func:`operators.keys.dense_index` (no global row_number).  Formulas beyond
the declared schemas are ours and stated in each docstring.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import dense_index, hot_keys_of, lookup_join


def _lookup(df: DataFrame, dim: DataFrame, natural: str, dim_natural: str, sk: str, out: str,
            hot: list | None = None) -> DataFrame:
    d = dim.select(F.col(dim_natural).alias(f"__n_{out}"), F.col(sk).alias(out))
    return lookup_join(df, d, natural, f"__n_{out}", hot=hot).drop(f"__n_{out}")


# F1 -------------------------------------------------------------------------
SALES_TS_FORMATS = ["yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm"]


def fact_sales_load(raw: DataFrame, dim_customer: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Text dates parsed (first format that fits), line_total = quantity x
    unit_price, customer and product keys looked up (unknown -> NULL).  The
    frequent keys of both lookups come from one reading of ``raw``, and only
    columns of the result go through the joins."""
    ts = F.coalesce(*[F.try_to_timestamp(F.col("invoice_date"), F.lit(f)) for f in SALES_TS_FORMATS])
    hot = hot_keys_of(raw, ["customer_id", "stock_code"])
    x = raw.select("invoice_no", "customer_id", "stock_code", "quantity", "unit_price", "country", ts.cast("timestamp_ntz").alias("__ts"))
    x = _lookup(x, dim_customer, "customer_id", "customer_id", "customer_sk", "customer_sk", hot["customer_id"])
    x = _lookup(x, dim_product, "stock_code", "stock_code", "product_sk", "product_sk", hot["stock_code"])
    return x.select(
        "invoice_no", "customer_sk", "product_sk", F.col("quantity").cast("bigint").alias("quantity"),
        F.col("unit_price").cast("decimal(10,2)").alias("unit_price"),
        (F.col("quantity") * F.col("unit_price")).cast("decimal(14,2)").alias("line_total"),
        "country", F.col("__ts").alias("invoice_ts"), F.to_date("__ts").alias("sale_date"))


# F2 -------------------------------------------------------------------------
def fact_supplier_invoice_lines(invoices: DataFrame, first_id: int = 1) -> DataFrame:
    """One row per invoice line (position kept); month partition column.
    Lines are numbered densely from ``first_id`` (a later load goes on after
    the largest id so far) by order, supplier, invoice and position."""
    x = invoices.select("*", F.posexplode("line_items").alias("__line", "__li"))
    sup = F.regexp_extract("supplier_id", r"(\d+)$", 1).cast("bigint")
    parts = F.split("invoice_no", "-")
    x = x.withColumns({"__order": F.get(parts, 0).cast("bigint"), "__from": F.get(parts, 1).cast("bigint")})
    x = dense_index(x, ["__order", "__from", "invoice_no", "__line"], "invoice_line_id", start=first_id)
    return x.select(
        "invoice_line_id",
        "invoice_no", sup.alias("supplier_sk"), F.col("__li.sku").alias("sku"),
        F.col("__li.qty").alias("quantity"), F.col("__li.unit_price").cast("decimal(12,4)").alias("unit_cost"),
        (F.col("__li.qty") * F.col("__li.unit_price")).cast("decimal(14,2)").alias("line_total"),
        F.col("currency").alias("currency_code"),
        F.col("invoice_date").cast("timestamp_ntz").alias("received_ts"),
        F.year("invoice_date").cast("bigint").alias("invoice_year"),
        F.month("invoice_date").cast("bigint").alias("invoice_month"),
        F.trunc("invoice_date", "month").alias("_partition_month"),
        F.col("__line").alias("line_position"))


# F3 -------------------------------------------------------------------------
def fact_shipments_fold(carrier_events: DataFrame) -> DataFrame:
    """Carrier events folded back to one row per tracking number with the
    events as a time-sorted array (bounded by events per shipment)."""
    loc = F.concat_ws(", ", "location_city", "location_region", "location_country")
    g = carrier_events.groupBy("tracking_no").agg(
        F.min("carrier").alias("carrier"),
        F.array_sort(F.collect_list(F.struct(F.col("event_ts").alias("ts"), F.col("event_type").alias("status"),
                                             loc.alias("location")))).alias("tracking_events"),
        F.min(F.when(F.col("event_type") == "SHIPPED", F.col("event_ts"))).alias("shipped_ts"),
        F.min(F.when(F.col("event_type") == "DELIVERED", F.col("event_ts"))).alias("delivered_ts"))
    return g.select(
        "tracking_no", "carrier", "shipped_ts", "delivered_ts", "tracking_events",
        F.year("shipped_ts").cast("bigint").alias("ship_year"), F.month("shipped_ts").cast("bigint").alias("ship_month"),
        F.dayofmonth("shipped_ts").cast("bigint").alias("ship_day"), F.col("carrier").alias("carrier_partition"),
        F.to_date("shipped_ts").alias("_partition_date"))


# F4 -------------------------------------------------------------------------
def fact_email_engagement(clicks: DataFrame) -> DataFrame:
    """Clicks folded per send: first click, its link, all clicks sorted.  A
    click that was delivered more than once (same time and link) is one, so
    repeats, which have no bound, are gone before lists are made; what is left
    of a send are the clicks of one recipient."""
    clicks = clicks.select("send_id", "campaign_id", "recipient", "clicked_at", "click_url").distinct()
    g = clicks.groupBy("send_id").agg(
        F.first("campaign_id").alias("campaign_id"), F.first("recipient").alias("recipient"),
        F.min("clicked_at").alias("event_ts"), F.min_by("click_url", "clicked_at").alias("link_url"),
        F.array_sort(F.collect_list(F.struct(F.col("clicked_at").alias("ts"), F.col("click_url").alias("url"))))
        .alias("clicks"))
    return g.select(
        "send_id", F.regexp_extract("campaign_id", r"(\d+)$", 1).cast("bigint").alias("campaign_sk"),
        F.col("recipient").cast("bigint").alias("user_sk"), F.lit("click").alias("event_type"),
        "event_ts", "link_url", "clicks", F.to_date("event_ts").alias("event_date"))


# F5 / F7 / F8 / F9 ----------------------------------------------------------
def fact_web_session(omniture_view: DataFrame) -> DataFrame:
    ts = F.to_timestamp_ntz(F.col("event_ts"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return omniture_view.select(ts.alias("event_ts"), "ip", "url", "user_id", "city", "state",
                                F.to_date(ts).alias("event_date"), "country")


def fact_app_clicks(mobile_events: DataFrame) -> DataFrame:
    return mobile_events.select(
        F.col("context.session_id").alias("session_id"), F.col("user_id").cast("bigint").alias("user_sk"),
        "event_ts", F.col("properties")["event_type"].alias("event_type"),
        F.lit(None).cast("string").alias("screen"), F.col("properties")["k"].alias("target_id"),
        "properties",
        F.struct(F.col("platform"), F.col("app_version").alias("version"), F.col("device_type").alias("model"))
        .alias("device"),
        F.to_date("event_ts").alias("event_date"), F.col("platform").alias("platform_partition"))


def fact_fraud_decisions(scored: DataFrame) -> DataFrame:
    """Decision by cutoffs: >= 0.8 DECLINE, >= 0.5 REVIEW, else APPROVE."""
    s = F.col("fraud_score")
    decision = F.when(s >= 0.8, "DECLINE").when(s >= 0.5, "REVIEW").otherwise("APPROVE")
    return scored.select("txn_id", F.col("customer_id").cast("bigint").alias("customer_sk"), "fraud_score",
                         decision.alias("decision"), F.col("signals").alias("rule_signals"),
                         F.col("scored_at").alias("decided_ts"), F.col("score_date").alias("decision_date"))


def fact_loyalty_load(parsed: DataFrame, dim_store: DataFrame) -> DataFrame:
    x = _lookup(parsed, dim_store, "store_id", "store_id", "store_sk", "store_sk")
    return x.select(F.col("tx_id").cast("bigint").alias("event_id"), "member_id", "event_type", "points",
                    "store_sk", "tx_id", "event_ts", "meta", F.to_date("event_ts").alias("event_date"))


# F10 ------------------------------------------------------------------------
def typed_fact(raw: DataFrame, columns: dict[str, Column], lookups: list[tuple] = (),
               partition: tuple[str, Column] | None = None) -> DataFrame:
    """Generic fact load: ``lookups`` = (natural col, dim, dim natural col,
    dim key col, output key col); ``columns`` = output name -> typed
    expression; ``partition`` = (name, expression)."""
    x = raw
    for nat, dim, dnat, sk, out in lookups:
        x = _lookup(x, dim, nat, dnat, sk, out)
    cols = [e.alias(n) for n, e in columns.items()]
    if partition:
        cols.append(partition[1].alias(partition[0]))
    return x.select(*cols)


def fact_returns_load(rmas: DataFrame, dim_customer: DataFrame, dim_product: DataFrame) -> DataFrame:
    cols = {
        "return_id": F.regexp_replace("rma_id", "[^0-9]", "").cast("decimal(38,0)").cast("bigint"),
        "invoice_no": F.col("invoice_no"), "customer_sk": F.col("customer_sk"), "product_sk": F.col("product_sk"),
        "return_ts": F.col("requested_at"), "quantity": F.col("quantity").cast("bigint"),
        "refund_amount": F.lit(None).cast("decimal(12,2)"), "reason_code": F.col("reason_code"),
        "return_channel": F.lit("store"), "store_sk": F.lit(None).cast("bigint"),
    }
    return typed_fact(rmas, cols, [("customer_id", dim_customer, "customer_id", "customer_sk", "customer_sk"),
                                   ("stock_code", dim_product, "product_natural", "product_sk", "product_sk")],
                      ("return_date", F.to_date("requested_at")))


# D1 -------------------------------------------------------------------------
# The holidays the calendar flags (month, day).
HOLIDAYS = [(1, 1), (7, 4), (12, 25)]


def dim_date_full(start: Column, end: Column, spark, as_of: dt.date,
                  fiscal_start_month: int = 7) -> DataFrame:
    """Calendar from ``start`` to ``end`` (date expressions over a one-row
    frame), 26 columns: sequences since 1900, fiscal year starting in
    ``fiscal_start_month``, holiday / weekend flags, same day last year and
    last quarter, and current-period flags relative to ``as_of``."""
    days = spark.range(1).select(F.explode(F.sequence(start, end)).alias("d")).repartition(8)
    d = F.col("d")
    sk = lambda c: (F.datediff(c, F.lit(dt.date(1900, 1, 1))) + 2415021).cast("bigint")
    hol = F.lit(False)
    for m, dd in HOLIDAYS:
        hol = hol | ((F.month(d) == m) & (F.dayofmonth(d) == dd))
    prev = F.date_sub(d, 1)
    prev_hol = F.lit(False)
    for m, dd in HOLIDAYS:
        prev_hol = prev_hol | ((F.month(prev) == m) & (F.dayofmonth(prev) == dd))
    fy_shift = F.add_months(d, 12 - fiscal_start_month + 1)
    yn = lambda c: F.when(c, "Y").otherwise("N")
    a = F.lit(as_of)
    return days.select(
        sk(d).alias("d_date_sk"), F.date_format(d, "yyyyMMdd").alias("d_date_id"), d.alias("d_date"),
        ((F.year(d) - 1900) * 12 + F.month(d) - 1).cast("bigint").alias("d_month_seq"),
        (F.floor(F.datediff(d, F.lit(dt.date(1899, 12, 31))) / 7) + 1).cast("bigint").alias("d_week_seq"),
        ((F.year(d) - 1900) * 4 + F.quarter(d) - 1).cast("bigint").alias("d_quarter_seq"),
        F.year(d).cast("bigint").alias("d_year"), (F.dayofweek(d) - 1).cast("bigint").alias("d_dow"),
        F.month(d).cast("bigint").alias("d_moy"), F.dayofmonth(d).cast("bigint").alias("d_dom"),
        F.quarter(d).cast("bigint").alias("d_qoy"), F.year(fy_shift).cast("bigint").alias("d_fy_year"),
        ((F.year(fy_shift) - 1900) * 4 + F.quarter(fy_shift) - 1).cast("bigint").alias("d_fy_quarter_seq"),
        F.date_format(d, "EEEE").alias("d_day_name"), yn(hol).alias("d_holiday"),
        yn(F.dayofweek(d).isin(1, 7)).alias("d_weekend"), yn(prev_hol).alias("d_following_holiday"),
        sk(F.trunc(d, "month")).alias("d_first_dom"), sk(F.last_day(d)).alias("d_last_dom"),
        sk(F.add_months(d, -12)).alias("d_same_day_ly"), sk(F.add_months(d, -3)).alias("d_same_day_lq"),
        yn(d == a).alias("d_current_day"),
        yn(F.floor(F.datediff(d, F.lit(dt.date(1899, 12, 31))) / 7)
           == F.floor(F.datediff(a, F.lit(dt.date(1899, 12, 31))) / 7)).alias("d_current_week"),
        yn(F.trunc(d, "month") == F.trunc(a, "month")).alias("d_current_month"),
        yn((F.year(d) == F.year(a)) & (F.quarter(d) == F.quarter(a))).alias("d_current_quarter"),
        yn(F.year(d) == F.year(a)).alias("d_current_year"))


def calendar_for(fact: DataFrame, date_col: str, spark, as_of: dt.date) -> DataFrame:
    """D1 over the span of a fact's dates (one scalar aggregate)."""
    span = fact.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).first()
    return dim_date_full(F.lit(span["lo"]), F.lit(span["hi"]), spark, as_of)


# D2 / D3 --------------------------------------------------------------------
def dim_customer_merge(existing: DataFrame, sales: DataFrame) -> DataFrame:
    """Known ids keep their key (first/last seen widened, latest country);
    new ids get keys after the current maximum, in id order."""
    seen = sales.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.min("invoice_ts").alias("__first"), F.max("invoice_ts").alias("__last"),
        F.max_by("country", "invoice_ts").alias("__country"))
    e = existing.select(F.col("customer_id").alias("__eid"), "customer_sk", "country", "first_seen_ts", "last_seen_ts")
    j = e.join(seen, e["__eid"] == seen.customer_id, "full_outer")
    known = j.filter(F.col("__eid").isNotNull()).select(
        "customer_sk", F.col("__eid").alias("customer_id"), F.coalesce("__country", "country").alias("country"),
        F.least("first_seen_ts", "__first").alias("first_seen_ts"),
        F.greatest("last_seen_ts", "__last").alias("last_seen_ts"))
    top = existing.agg(F.coalesce(F.max("customer_sk"), F.lit(0)).alias("m")).first()["m"]
    new = j.filter(F.col("__eid").isNull()).select(
        "customer_id", F.col("__country").alias("country"), F.col("__first").alias("first_seen_ts"),
        F.col("__last").alias("last_seen_ts"))
    new = dense_index(new, ["customer_id"], "customer_sk", start=int(top) + 1)
    return known.unionByName(new.select(*known.columns))


def type1_dimension(existing: DataFrame, incoming: DataFrame, natural: str, sk: str,
                    attrs: list[str]) -> DataFrame:
    """D3: type-1 overwrite; known keys keep their surrogate key and take
    the incoming attributes (NULL included), new keys are numbered after the
    maximum.  Of several incoming rows of one key the largest by its
    attributes counts; rows without a key are left out."""
    inc = (incoming.filter(F.col(natural).isNotNull()).groupBy(F.col(natural).alias("__n"))
           .agg(F.max(F.struct(*attrs)).alias("__i"))
           .select("__n", *[F.col(f"__i.{a}").alias(f"__i_{a}") for a in attrs]))
    j = existing.join(inc, existing[natural] == inc["__n"], "full_outer")
    known = j.filter(F.col(natural).isNotNull()).select(
        sk, natural, *[F.when(F.col("__n").isNotNull(), F.col(f"__i_{a}")).otherwise(F.col(a)).alias(a) for a in attrs])
    top = existing.agg(F.coalesce(F.max(sk), F.lit(0)).alias("m")).first()["m"]
    new = j.filter(F.col(natural).isNull()).select(F.col("__n").alias(natural),
                                                   *[F.col(f"__i_{a}").alias(a) for a in attrs])
    new = dense_index(new, [natural], sk, start=int(top) + 1)
    return known.unionByName(new.select(*known.columns))


# B3 / B4 --------------------------------------------------------------------
# Confidence per RFM segment (ours).
SEGMENT_CONFIDENCE = {"active": "0.900", "warm": "0.750", "cold": "0.600", "churned": "0.500", "never": "1.000"}


def bridge_customer_segment(clv: DataFrame, as_of: dt.date, valid_days: int = 30) -> DataFrame:
    conf = None
    for k, v in SEGMENT_CONFIDENCE.items():
        c = F.col("rfm_bucket") == k
        conf = F.when(c, F.lit(v)) if conf is None else conf.when(c, F.lit(v))
    return clv.select(
        "customer_sk", F.concat(F.lit("RFM_"), F.upper("rfm_bucket")).alias("segment_id"),
        F.initcap("rfm_bucket").alias("segment_name"), F.lit(as_of).alias("assigned_dt"),
        F.date_add(F.lit(as_of), valid_days).alias("expires_dt"), conf.cast("decimal(4,3)").alias("confidence"),
        F.lit("rfm").alias("source"), F.lit(as_of).alias("snapshot_date"))


def bridge_promo_eligibility(segments: DataFrame, promotions: DataFrame, as_of: dt.date,
                             max_broadcast_rows: int = 100_000, salt_buckets: int = 64) -> DataFrame:
    """Customer x promotion where the promotion's rule names the customer's
    segment and ``as_of`` lies in the promotion window.  Promotions are
    broadcast only after a row count under ``max_broadcast_rows``: the
    segment key has a handful of values, so a plain shuffle join would put a
    whole segment in one task; above the bound the join is salted instead
    (customers spread over ``salt_buckets``, promotions copied to each)."""
    live = promotions.filter((F.col("start_dt") <= F.lit(as_of)) & (F.col("end_dt") >= F.lit(as_of))).select(
        "promo_sk", F.col("eligibility")["segment"].alias("__seg"), "start_dt", "end_dt")
    if live.count() <= max_broadcast_rows:
        j = segments.join(F.broadcast(live), F.col("segment_name") == F.col("__seg"))
    else:  # too many promotions to broadcast: salt the few hot segment keys
        n = salt_buckets
        seg = segments.withColumn("__salt", F.abs(F.xxhash64("customer_sk")) % n)
        pro = live.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).cast("long"))
        j = seg.join(pro, (F.col("segment_name") == F.col("__seg")) & (seg["__salt"] == pro["__salt"]))
    return j.select("customer_sk", "promo_sk", F.lit(True).alias("eligible"),
                    F.concat(F.lit("segment:"), F.col("__seg")).alias("reason"),
                    F.col("start_dt").alias("valid_from"), F.col("end_dt").alias("valid_to"),
                    F.lit(as_of).alias("load_date"))


# B1 / B5 --------------------------------------------------------------------
PRODUCT_ATTRIBUTES = ["color", "size", "category", "subcategory"]


def bridge_product_attribute(feed: DataFrame) -> DataFrame:
    """Attributes unpivoted to rows (normalised text); when feeds disagree
    the value of the newest feed is the primary one; sort_order follows
    PRODUCT_ATTRIBUTES."""
    # dealt before the rows are multiplied: the first step of the count keeps
    # a row per value it meets, and one task may read a whole feed
    dealt = feed.select("sku", "feed_date", *PRODUCT_ATTRIBUTES).repartition("sku", "feed_date")
    norm = dealt.select("sku", "feed_date", *[F.lower(F.trim(a)).alias(a) for a in PRODUCT_ATTRIBUTES])
    u = norm.unpivot(["sku", "feed_date"], PRODUCT_ATTRIBUTES, "attribute_name", "attribute_value")
    g = u.filter(F.col("attribute_value").isNotNull()).groupBy("sku", "attribute_name", "attribute_value").agg(
        F.max("feed_date").alias("__last"))
    w = Window.partitionBy("sku", "attribute_name").orderBy(F.col("__last").desc(), F.col("attribute_value").asc())
    order = F.array_position(F.array(*[F.lit(a) for a in PRODUCT_ATTRIBUTES]), F.col("attribute_name"))
    return g.select(F.substring("sku", 4, 20).cast("bigint").alias("product_sk"), "attribute_name",
                    "attribute_value", (F.row_number().over(w) == 1).alias("primary_value"),
                    order.cast("bigint").alias("sort_order"))


def bridge_employee_role(snapshots: DataFrame) -> DataFrame:
    """Each role an employee held, with its date range; the primary role is
    the one with the most transactions (ties: role name)."""
    g = snapshots.groupBy("employee_sk", "role").agg(
        F.min("eff_date").alias("eff_from"),
        F.max(F.make_date(F.col("yr").cast("int"), F.lit(12), F.lit(31))).alias("eff_to"),
        F.sum("txns").alias("__t"))
    w = Window.partitionBy("employee_sk").orderBy(F.col("__t").desc(), F.col("role").asc())
    return g.select("employee_sk", "role", (F.row_number().over(w) == 1).alias("primary_role"), "eff_from", "eff_to")


# F6 -------------------------------------------------------------------------
def fact_inventory_snapshot(movements: DataFrame) -> DataFrame:
    """Day-end on-hand per (sku, warehouse): IN adds, anything else
    subtracts; a running sum over the days with movements (two-level per
    key, bucketed by month, so a hot sku is not one task)."""
    signed = F.when(F.col("movement_type") == "IN", F.col("quantity")).otherwise(-F.col("quantity"))
    daily = movements.groupBy("sku", "warehouse_id", F.to_date("movement_ts").alias("snapshot_date")).agg(
        F.sum(signed).alias("__net"), F.max("movement_ts").alias("last_movement_ts"))
    from ..operators.sequence import running_sum
    r = running_sum(daily, ["sku", "warehouse_id"], ["snapshot_date"], "__net", "on_hand_units",
                    bucket=F.trunc("snapshot_date", "month"))
    return r.select("sku", F.substring("warehouse_id", 3, 10).cast("bigint").alias("warehouse_sk"),
                    F.col("on_hand_units").cast("bigint").alias("on_hand_units"),
                    F.lit(0).cast("bigint").alias("allocated_units"), F.lit(0).cast("bigint").alias("in_transit_units"),
                    F.col("on_hand_units").cast("bigint").alias("available_units"),
                    F.lit(None).cast("decimal(12,4)").alias("avg_cost"), "last_movement_ts", "snapshot_date")
