"""Registered queries for A1-A10 and B2 with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..oracle_fixtures import K, _pick, date_lit, hu_div
from ..registry import REGISTRY, register
from ..session import scratch_table
from ..sources import testdata as td
from . import aggregates as a
from .refresh import INGEST, refresh

S, SH = td.SALES_AS_OF, td.SHIP_AS_OF


def _cube_key(dims):
    parts = [f"CASE WHEN GROUPING({d}) = 1 THEN '*' ELSE COALESCE(CAST({d} AS VARCHAR), '') END"
             for d in dims]
    return "concat_ws('|', " + ", ".join(parts) + ")"


@register("A1_sales_cube", f"""
SELECT CAST(GROUPING(country, month_key, product_sk) AS BIGINT) AS dim_level,
       {_cube_key(['country', 'month_key', 'product_sk'])} AS cube_key,
       country, month_key, product_sk,
       COUNT(DISTINCT invoice_no) AS orders, CAST(SUM(line_total) AS DECIMAL(18,2)) AS revenue,
       CAST(SUM(quantity) AS BIGINT) AS units, {date_lit(S)} AS as_of_date
FROM (SELECT *, CAST(year(sale_date) * 100 + month(sale_date) AS BIGINT) AS month_key
      FROM fx_fact_sales WHERE sale_date <= {date_lit(S)}) t
GROUP BY CUBE(country, month_key, product_sk)""")
def q_a1(spark, sf):
    return a.sales_cube(td.fact_sales(spark, sf), S)


@register("A2_top_countries_daily", """
SELECT as_of_date, country, orders, revenue, rank FROM (
  SELECT sale_date AS as_of_date, country, COUNT(DISTINCT invoice_no) AS orders,
         CAST(SUM(line_total) AS DECIMAL(18,2)) AS revenue,
         ROW_NUMBER() OVER (PARTITION BY sale_date
                            ORDER BY SUM(line_total) DESC NULLS LAST, country ASC NULLS LAST) AS rank
  FROM fx_fact_sales GROUP BY sale_date, country) t
WHERE rank <= 5""")
def q_a2(spark, sf):
    return a.top_countries_daily(td.fact_sales(spark, sf), 5)


@register("A3_daily_sales_by_store", f"""
WITH s AS (SELECT store_sk, sale_date, SUM(line_total) AS gross, SUM(quantity) AS units,
                  COUNT(DISTINCT invoice_no) AS txns FROM fx_fact_sales GROUP BY store_sk, sale_date),
r AS (SELECT store_sk, return_date AS sale_date, SUM(refund_amount) AS refunds
      FROM fx_returns GROUP BY store_sk, return_date),
j AS (SELECT COALESCE(s.store_sk, r.store_sk) AS store_sk, COALESCE(s.sale_date, r.sale_date) AS sale_date,
             COALESCE(gross, 0) AS gross, COALESCE(units, 0) AS units, COALESCE(txns, 0) AS txns,
             COALESCE(refunds, 0) AS refunds
      FROM s FULL OUTER JOIN r ON s.store_sk = r.store_sk AND s.sale_date = r.sale_date)
SELECT store_sk, CAST(gross AS DECIMAL(16,2)) AS gross_revenue,
       CAST(gross - refunds AS DECIMAL(16,2)) AS net_revenue, CAST(units AS BIGINT) AS units_sold,
       txns AS txn_count, {hu_div('gross', 'txns', 2, num_scale=2, out='DECIMAL(12,2)')} AS avg_basket,
       sale_date
FROM j""")
def q_a3(spark, sf):
    return a.daily_sales_by_store(td.fact_sales(spark, sf), td.fact_returns(spark, sf))


_B2_SQL = """
SELECT product_sk, supplier_sk,
       ROW_NUMBER() OVER (PARTITION BY product_sk ORDER BY unit_cost, lead_time_days, supplier_sk) = 1
         AS primary_supplier,
       supplier_sku, unit_cost, lead_time_days, moq, DATE '1995-01-01' AS valid_from,
       CAST(NULL AS DATE) AS valid_to
FROM fx_offers"""


@register("B2_bridge_product_supplier", _B2_SQL)
def q_b2(spark, sf):
    return a.bridge_product_supplier(td.product_supplier_offers(spark, sf))


@register("A4_daily_sales_by_product", f"""
WITH s AS (SELECT product_sk, sale_date, SUM(quantity) AS units, SUM(line_total) AS gross
           FROM fx_fact_sales GROUP BY product_sk, sale_date),
r AS (SELECT product_sk, return_date AS sale_date, SUM(quantity) AS ret
      FROM fx_returns GROUP BY product_sk, return_date),
b AS (SELECT product_sk, unit_cost FROM ({_B2_SQL}) x WHERE primary_supplier),
j AS (SELECT COALESCE(s.product_sk, r.product_sk) AS product_sk, COALESCE(s.sale_date, r.sale_date) AS sale_date,
             CAST(COALESCE(units, 0) AS BIGINT) AS units, CAST(COALESCE(gross, 0) AS DECIMAL(16,2)) AS gross,
             CAST(COALESCE(ret, 0) AS BIGINT) AS ret
      FROM s FULL OUTER JOIN r ON s.product_sk = r.product_sk AND s.sale_date = r.sale_date),
k AS (SELECT j.*, CAST(j.units * b.unit_cost AS DECIMAL(16,2)) AS cogs FROM j LEFT JOIN b ON j.product_sk = b.product_sk)
SELECT product_sk, units AS units_sold, gross AS gross_revenue,
       {hu_div('(gross - cogs) * 100', 'gross * 100', 4, out='DECIMAL(6,4)')} AS margin_pct,
       cogs, ret AS return_units, units - ret AS net_units, sale_date
FROM k""")
def q_a4(spark, sf):
    return a.daily_sales_by_product(td.fact_sales(spark, sf), td.fact_returns(spark, sf),
                                    a.bridge_product_supplier(td.product_supplier_offers(spark, sf)))


def _digit_sql(x, bounds, le):
    op = "<=" if le else ">="
    whens = " ".join(f"WHEN {x} {op} {b} THEN '{5 - i}'" for i, b in enumerate(bounds))
    return f"(CASE {whens} ELSE '1' END)"


@register("A5_weekly_customer_ltv", f"""
WITH per AS (SELECT customer_sk, SUM(line_total) AS ltv, COUNT(DISTINCT invoice_no) AS orders,
                    MAX(sale_date) AS last
             FROM fx_fact_sales WHERE sale_date <= {date_lit(S)} AND customer_sk IS NOT NULL
             GROUP BY customer_sk),
d AS (SELECT *, CAST(date_diff('day', last, {date_lit(S)}) AS BIGINT) AS days FROM per)
SELECT customer_sk, CAST(ltv AS DECIMAL(16,2)) AS ltv_to_date, orders AS orders_to_date,
       {hu_div('ltv', 'orders', 2, num_scale=2, out='DECIMAL(12,2)')} AS avg_order_value,
       days AS days_since_last_order,
       {_digit_sql('days', a.RECENCY_DAYS, True)} || {_digit_sql('orders', a.FREQUENCY_ORDERS, False)}
         || {_digit_sql('ltv', a.MONETARY_LTV, False)} AS rfm_score,
       {hu_div('LEAST(days, 365)', '365', 3, out='DECIMAL(4,3)')} AS churn_risk,
       CAST(date_trunc('week', {date_lit(S)}) AS DATE) AS week_start_date
FROM d""")
def q_a5(spark, sf):
    return a.weekly_customer_ltv(td.fact_sales(spark, sf), S)


def _cuts_sql(x):
    """Four cutoffs: the least value that a fifth, two fifths ... of all
    customers do not exceed."""
    return (f"SELECT " + ", ".join(f"MIN({x}) FILTER (k * 5 >= {j} * n) AS c{j}" for j in (1, 2, 3, 4))
            + f" FROM (SELECT {x}, ROW_NUMBER() OVER (ORDER BY {x}) AS k, COUNT(*) OVER () AS n FROM d)")


def _below_sql(x, t):
    return " + ".join(f"CASE WHEN {t}.c{j} < {x} THEN 1 ELSE 0 END" for j in (1, 2, 3, 4))


@register("A5b_weekly_customer_ltv_quintiles", f"""
WITH per AS (SELECT customer_sk, SUM(line_total) AS ltv, COUNT(DISTINCT invoice_no) AS orders,
                    MAX(sale_date) AS last
             FROM fx_fact_sales WHERE sale_date <= {date_lit(S)} AND customer_sk IS NOT NULL
             GROUP BY customer_sk),
d AS (SELECT *, CAST(date_diff('day', last, {date_lit(S)}) AS BIGINT) AS days FROM per),
r AS ({_cuts_sql('days')}), f AS ({_cuts_sql('orders')}), m AS ({_cuts_sql('ltv')})
SELECT customer_sk, CAST(ltv AS DECIMAL(16,2)) AS ltv_to_date, orders AS orders_to_date,
       {hu_div('ltv', 'orders', 2, num_scale=2, out='DECIMAL(12,2)')} AS avg_order_value,
       days AS days_since_last_order,
       CAST(5 - ({_below_sql('days', 'r')}) AS VARCHAR) || CAST(1 + {_below_sql('orders', 'f')} AS VARCHAR)
         || CAST(1 + {_below_sql('ltv', 'm')} AS VARCHAR) AS rfm_score,
       {hu_div('LEAST(days, 365)', '365', 3, out='DECIMAL(4,3)')} AS churn_risk,
       CAST(date_trunc('week', {date_lit(S)}) AS DATE) AS week_start_date
FROM d, r, f, m""")
def q_a5b(spark, sf):
    return a.weekly_customer_ltv(td.fact_sales(spark, sf), S, quintiles=True)


@register("A8_daily_carrier_otd", f"""
WITH g AS (
  SELECT carrier, CAST(shipped_ts AS DATE) AS ship_date, COUNT(*) AS shipments_total,
         COUNT(CASE WHEN delivered_ts IS NOT NULL AND delivered_ts <= shipped_ts + INTERVAL 48 HOUR THEN 1 END) AS delivered_on_time,
         COUNT(CASE WHEN delivered_ts IS NOT NULL AND delivered_ts > shipped_ts + INTERVAL 48 HOUR THEN 1 END) AS delivered_late,
         COUNT(CASE WHEN delivered_ts IS NULL THEN 1 END) AS in_transit,
         SUM(date_diff('second', shipped_ts, delivered_ts)) AS secs
  FROM fx_shipments GROUP BY carrier, CAST(shipped_ts AS DATE))
SELECT carrier, shipments_total, delivered_on_time, delivered_late, in_transit,
       {hu_div('delivered_on_time', 'delivered_on_time + delivered_late', 4, out='DECIMAL(5,4)')} AS otd_pct,
       {hu_div('secs', '(delivered_on_time + delivered_late) * 3600', 2, out='DECIMAL(8,2)')} AS avg_transit_hours,
       ship_date
FROM g""")
def q_a8(spark, sf):
    return a.daily_carrier_otd(td.fact_shipments(spark, sf))


@register("A10_returns_by_reason_monthly", f"""
WITH sale AS (SELECT invoice_no, product_sk, MIN(sale_date) AS sold_on FROM fx_fact_sales
              GROUP BY invoice_no, product_sk),
j AS (SELECT r.*, date_diff('day', s.sold_on, r.return_date) AS days
      FROM fx_returns r LEFT JOIN sale s ON r.invoice_no = s.invoice_no AND r.product_sk = s.product_sk)
SELECT reason_code, COUNT(*) AS return_count, CAST(SUM(quantity) AS BIGINT) AS return_units,
       CAST(SUM(refund_amount) AS DECIMAL(16,2)) AS total_refunded,
       {hu_div('SUM(days)', 'COUNT(days)', 2, out='DECIMAL(8,2)')} AS avg_days_to_return,
       CAST(date_trunc('month', return_date) AS DATE) AS month_start
FROM j GROUP BY reason_code, CAST(date_trunc('month', return_date) AS DATE)""")
def q_a10(spark, sf):
    return a.returns_by_reason_monthly(td.fact_returns(spark, sf), td.fact_sales(spark, sf))


@register("A6_monthly_supplier_performance", f"""
WITH r AS (
  SELECT l_suppkey AS supplier_sk, l_orderkey, CAST(l_quantity AS BIGINT) AS quantity, l_shipdate AS shipped_ts,
         CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_shipdate + to_hours(CAST(l_partkey % 96 AS BIGINT)) END AS delivered_ts,
         l_linestatus, l_returnflag,
         CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(14,2)) AS line_total
  FROM lineitem),
g AS (
  SELECT supplier_sk, CAST(date_trunc('month', shipped_ts) AS DATE) AS month_start,
         COUNT(DISTINCT l_orderkey) AS orders_placed, CAST(SUM(quantity) AS BIGINT) AS units_received,
         COUNT(CASE WHEN delivered_ts IS NOT NULL AND delivered_ts <= shipped_ts + INTERVAL 48 HOUR THEN 1 END) AS ot,
         COUNT(delivered_ts) AS dl, COUNT(CASE WHEN l_linestatus = 'F' THEN 1 END) AS f, COUNT(*) AS n,
         COUNT(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS ok,
         SUM(date_diff('second', shipped_ts, delivered_ts)) AS s, SUM(line_total) AS spend
  FROM r GROUP BY supplier_sk, CAST(date_trunc('month', shipped_ts) AS DATE))
SELECT supplier_sk, orders_placed, units_received,
       {hu_div('ot', 'dl', 4, out='DECIMAL(5,4)')} AS on_time_pct,
       {hu_div('f', 'n', 4, out='DECIMAL(5,4)')} AS fill_rate_pct,
       {hu_div('s', 'dl * 86400', 2, out='DECIMAL(6,2)')} AS avg_lead_time_days,
       {hu_div('ok', 'n', 3, out='DECIMAL(4,3)')} AS quality_score,
       CAST(spend AS DECIMAL(16,2)) AS total_spend, month_start
FROM g""")
def q_a6(spark, sf):
    return a.monthly_supplier_performance(td.supplier_receipts(spark, sf))


def td_referrer_sql() -> str:
    return _pick("e.k % 4", td.REFERRERS)


_CHANNEL = ("CASE WHEN t.r IS NULL OR regexp_extract(t.r, '^https?://([a-z]+)\\.', 1) = '' THEN 'direct' "
            "ELSE regexp_extract(t.r, '^https?://([a-z]+)\\.', 1) END")


@register("A9_marketing_attribution_cube", f"""
WITH ev AS (
  SELECT CAST(e.user_id AS VARCHAR) AS user_id, e.ts AS event_ts, {td_referrer_sql()} AS referrer,
         e.k % 5 AS campaign_sk, st.region
  FROM fx_events_k e LEFT JOIN fx_dim_store st ON st.store_sk = e.user_id % 10
  WHERE e.event_type IN ('click', 'view')),
pairs AS (
  SELECT f.invoice_no, ev.event_ts, ev.referrer, ev.campaign_sk, ev.region, f.line_total
  FROM ev JOIN fx_dim_customer dc ON dc.customer_id = ev.user_id
  JOIN fx_app_sales f ON f.customer_sk = dc.customer_sk
   AND f.invoice_ts BETWEEN ev.event_ts AND ev.event_ts + INTERVAL 1 DAY),
last AS (
  SELECT invoice_no, arg_max({{'r': referrer, 'c': campaign_sk, 'g': region}}, event_ts) AS t,
         any_value(line_total) AS line_total
  FROM pairs GROUP BY invoice_no),
x AS (
  SELECT {_CHANNEL} AS channel, t.c AS campaign_sk, t.g AS region, line_total
  FROM last),
y AS (
  SELECT *, CAST(CASE channel {' '.join(f"WHEN '{k}' THEN {v}" for k, v in a.CHANNEL_COST.items())} END
                 AS DECIMAL(6,2)) AS c FROM x),
cube AS (
  SELECT channel, campaign_sk, region, CAST(SUM(line_total) AS DECIMAL(16,2)) AS attributed_revenue,
         COUNT(*) AS attributed_units, CAST(SUM(c) AS DECIMAL(14,2)) AS cost,
         CAST(GROUPING(channel, campaign_sk, region) AS BIGINT) AS grouping_id
  FROM y GROUP BY CUBE(channel, campaign_sk, region))
SELECT channel, campaign_sk, region, attributed_revenue, attributed_units, cost,
       {hu_div('attributed_revenue * 100', 'cost * 100', 4, out='DECIMAL(8,4)')} AS roas,
       grouping_id, {date_lit(td.EVENTS_AS_OF)} AS period_date
FROM cube""")
def q_a9(spark, sf):
    from pyspark.sql import functions as F
    me = td.mobile_events(spark, sf)
    stores = td.dim_store(spark, sf).select(F.col("store_sk").alias("__st"), "region")
    ev = me.select("user_id", "event_ts", F.col("context.referrer").alias("referrer"),
                   (F.col("properties")["k"].cast("bigint") % 5).alias("campaign_sk"),
                   (F.col("user_id").cast("bigint") % 10).alias("__store"))
    from ..operators.keys import lookup_join
    ev = lookup_join(ev, stores, "__store", "__st").drop("__store", "__st")  # hot stores
    dc = td.dim_customer(spark, sf).select("customer_id", "customer_sk")
    evc = lookup_join(ev, dc, "user_id", "customer_id", "inner").drop("customer_id")  # hot users
    last = a.last_touch(td.app_sales(spark, sf), evc, 1)
    return a.marketing_attribution_cube(last, td.EVENTS_AS_OF)


@register("P3_late_arrivals_refresh_otd", REGISTRY["A8_daily_carrier_otd"].oracle)
def q_p3(spark, sf):
    """A8 kept up to date: most shipments arrive on the first day, a
    twentieth of those of the last 90 days on two later ones; the refreshed
    table is read back."""
    recent = F.col("shipped_ts") > F.date_sub(F.lit(SH), 90)
    late = F.when(recent, F.pmod(F.xxhash64("shipment_id"), F.lit(40)))
    arrived = F.date_add(F.lit(SH), F.when(late == 0, 2).when(late == 1, 1).otherwise(0))
    landing, out = scratch_table(spark, "shipments_landed"), scratch_table(spark, "carrier_otd")
    # no exchange by day: the first day holds nearly all rows, and would be one task
    td.fact_shipments(spark, sf).withColumn(INGEST, arrived).write.partitionBy(INGEST).parquet(landing)
    landed, since = spark.read.parquet(landing), None
    for day in range(3):
        upto = F.date_add(F.lit(SH), day)
        since = refresh(landed.filter(F.col(INGEST) <= upto), since, F.to_date("shipped_ts"), a.daily_carrier_otd, out, "ship_date").upto
    return spark.read.parquet(out)
