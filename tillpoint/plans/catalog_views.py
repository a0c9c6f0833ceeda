"""Registered queries for V1-V14 and U1, each with its DuckDB oracle.

The oracles restate the reference's view SQL over the oracle-side fixture
CTEs; the Spark side is the DataFrame builder in :mod:`plans.views`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.country import normalize_country
from ..oracle_fixtures import date_lit, days_back, norm_country_sql
from ..registry import register
from ..session import scratch_table
from ..sources import testdata as td
from . import views as v

S, E, SH, R = td.SALES_AS_OF, td.EVENTS_AS_OF, td.SHIP_AS_OF, td.RETURNS_AS_OF


@register("V1_daily_sales_by_country", """
WITH daily AS (
  SELECT sale_date, country, COUNT(DISTINCT invoice_no) AS orders, SUM(line_total) AS revenue,
         CAST(SUM(quantity) AS BIGINT) AS units, COUNT(DISTINCT customer_sk) AS active_customers
  FROM fx_fact_sales GROUP BY sale_date, country)
SELECT sale_date, country, orders, revenue, units, active_customers,
       COALESCE(round(CAST(revenue AS DOUBLE) / NULLIF(orders, 0), 6), 0) AS aov,
       COALESCE(round(CAST(units AS DOUBLE) / NULLIF(orders, 0), 6), 0) AS basket_size
FROM daily""")
def q_v1(spark, sf):
    return v.daily_sales_by_country(td.fact_sales(spark, sf))


@register("V2_weekly_running_totals", """
WITH weekly AS (
  SELECT d.d_week_seq, d.d_year, SUM(f.line_total) AS wk_revenue, CAST(SUM(f.quantity) AS BIGINT) AS wk_units
  FROM fx_fact_sales f JOIN fx_dim_date d ON d.d_date = f.sale_date
  GROUP BY d.d_week_seq, d.d_year)
SELECT d_week_seq, d_year, wk_revenue, wk_units,
  SUM(wk_revenue) OVER (PARTITION BY d_year ORDER BY d_week_seq) AS ytd_revenue,
  round(CAST(SUM(wk_revenue) OVER w13 AS DOUBLE) / COUNT(*) OVER w13, 6) AS rolling_13wk_avg,
  LAG(wk_revenue, 52) OVER w AS same_week_last_year,
  wk_revenue - COALESCE(LAG(wk_revenue, 52) OVER w, 0) AS yoy_delta
FROM weekly
WINDOW w AS (ORDER BY d_week_seq, d_year),
       w13 AS (ORDER BY d_week_seq, d_year ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)""")
def q_v2(spark, sf):
    f = td.fact_sales(spark, sf).groupBy("sale_date").agg(*[F.sum(c).alias(c) for c in ("line_total", "quantity")]).checkpoint()
    days = f.agg(F.min("sale_date").alias("lo"), F.max("sale_date").alias("hi")).first()
    # the calendar spans the fact, so no sale falls outside of it
    return v.weekly_running_totals(f, td.dim_date(spark, days["lo"], days["hi"]) if days["lo"] else td.dim_date(spark))


@register("V3_customer_lifetime_value", f"""
WITH per_customer AS (
  SELECT c.customer_sk, c.customer_id, c.country,
         MIN(f.sale_date) AS first_order_date, MAX(f.sale_date) AS last_order_date,
         COUNT(DISTINCT f.invoice_no) AS orders, SUM(f.line_total) AS lifetime_revenue
  FROM fx_dim_customer c LEFT JOIN fx_fact_sales f ON f.customer_sk = c.customer_sk
  GROUP BY c.customer_sk, c.customer_id, c.country)
SELECT customer_sk, customer_id, country, first_order_date, last_order_date, orders, lifetime_revenue,
  date_diff('day', last_order_date, {date_lit(S)}) AS recency_days,
  CASE WHEN orders = 0 THEN 'never'
       WHEN date_diff('day', last_order_date, {date_lit(S)}) <= 30 THEN 'active'
       WHEN date_diff('day', last_order_date, {date_lit(S)}) <= 90 THEN 'warm'
       WHEN date_diff('day', last_order_date, {date_lit(S)}) <= 365 THEN 'cold'
       ELSE 'churned' END AS rfm_bucket
FROM per_customer""")
def q_v3(spark, sf):
    return v.customer_lifetime_value(td.dim_customer(spark, sf), td.fact_sales(spark, sf), S)


@register("V4_product_performance", """
WITH sold AS (
  SELECT p.product_sk, p.stock_code, p.description, f.country,
         SUM(f.line_total) AS revenue, CAST(SUM(f.quantity) AS BIGINT) AS units,
         COUNT(DISTINCT f.invoice_no) AS orders
  FROM fx_dim_product p JOIN fx_fact_sales f ON f.product_sk = p.product_sk
  GROUP BY p.product_sk, p.stock_code, p.description, f.country)
SELECT s.*,
  RANK() OVER (PARTITION BY s.country ORDER BY s.revenue DESC NULLS LAST) AS country_rank,
  DENSE_RANK() OVER (ORDER BY s.revenue DESC NULLS LAST) AS global_rank
FROM sold s""")
def q_v4(spark, sf):
    return v.product_performance(td.dim_product(spark, sf), td.fact_sales(spark, sf))


@register("V5_cohort_retention", """
WITH first_order AS (
  SELECT customer_sk, strftime(MIN(sale_date), '%Y-%m') AS cohort_month
  FROM fx_fact_sales GROUP BY customer_sk),
ords AS (
  SELECT f.customer_sk, fo.cohort_month,
         date_diff('month', CAST(fo.cohort_month || '-01' AS DATE), f.sale_date) AS months_since_first
  FROM fx_fact_sales f JOIN first_order fo ON fo.customer_sk = f.customer_sk)
SELECT cohort_month, CAST(months_since_first AS BIGINT) AS months_since_first,
       COUNT(DISTINCT customer_sk) AS active_customers
FROM ords GROUP BY cohort_month, CAST(months_since_first AS BIGINT)""")
def q_v5(spark, sf):
    return v.cohort_retention(td.fact_sales(spark, sf))


@register("V6_session_to_order", """
SELECT s.user_id, s.event_ts AS session_ts, s.referrer, f.invoice_no, f.invoice_ts AS order_ts, f.line_total
FROM fx_mobile_events s
LEFT JOIN fx_dim_customer dc ON dc.customer_id = s.user_id
LEFT JOIN fx_app_sales f ON f.customer_sk = dc.customer_sk
      AND f.invoice_ts BETWEEN s.event_ts AND s.event_ts + INTERVAL 1 DAY""")
def q_v6(spark, sf):
    return v.session_to_order(td.mobile_events(spark, sf), td.dim_customer(spark, sf),
                              td.app_sales(spark, sf))


# The approximate column has no value oracle; at the checked scale every
# region has few enough members that HLL++ is exact, so the exact count
# stands in for it.  tests/ bound the error separately.
@register("V7_active_member_panel", f"""
SELECT s.region, COUNT(DISTINCT l.member_id) AS approx_active_members,
       COUNT(DISTINCT l.member_id) AS exact_active_members,
       CAST(SUM(l.points) AS BIGINT) AS total_points_redeemed
FROM fx_loyalty l LEFT JOIN fx_dim_store s ON s.store_sk = l.store_sk
WHERE l.event_type = 'REDEEM' AND l.event_date >= {days_back(E, 30)}
GROUP BY s.region""")
def q_v7(spark, sf):
    return v.active_member_panel(td.fact_loyalty_events(spark, sf), td.dim_store(spark, sf), E)


SPANS = [1, 7, 30]


@register("V7b_active_members_from_sketches", "\nUNION ALL\n".join(f"""
SELECT {n} AS days, s.region, COUNT(DISTINCT l.member_id) AS approx_active_members,
       CAST(SUM(l.points) AS BIGINT) AS total_points_redeemed
FROM fx_loyalty l LEFT JOIN fx_dim_store s ON s.store_sk = l.store_sk
WHERE l.event_type = 'REDEEM' AND l.event_date >= {days_back(E, n)}
GROUP BY s.region""" for n in SPANS))
def q_v7b(spark, sf):
    path = scratch_table(spark, "member_sketches")
    v.member_sketches(td.fact_loyalty_events(spark, sf), td.dim_store(spark, sf)).write.parquet(path)
    return v.members_from_sketches(spark.read.parquet(path), E, SPANS)


@register("V8_sales_rollup_by_region", f"""
SELECT s.region, s.store_sk, SUM(f.line_total) AS total_revenue, COUNT(*) AS line_count,
       GROUPING(s.region) * 2 + GROUPING(s.store_sk) AS grouping_level
FROM fx_fact_sales f JOIN fx_dim_store s ON s.store_sk = f.store_sk
WHERE f.sale_date >= {days_back(S, 7)}
GROUP BY ROLLUP(s.region, s.store_sk)""")
def q_v8(spark, sf):
    return v.sales_rollup_by_region(td.fact_sales(spark, sf), td.dim_store(spark, sf), S)


@register("V8b_sales_rollup_as_written", f"""
SELECT s.region, s.store_sk, SUM(f.line_total) AS total_revenue, COUNT(*) AS line_count,
       GROUPING(s.region) * 2 + GROUPING(s.store_sk) AS grouping_level
FROM fx_fact_sales f JOIN fx_dim_store s ON s.store_sk = f.customer_sk
WHERE f.sale_date >= {days_back(S, 7)}
GROUP BY ROLLUP(s.region, s.store_sk)""")
def q_v8b(spark, sf):
    return v.sales_rollup_by_region(td.fact_sales(spark, sf), td.dim_store(spark, sf), S,
                                    fact_key="customer_sk")


@register("V9_category_hierarchy", """
WITH RECURSIVE cat_tree (category_id, name, parent_id, path, depth) AS (
  SELECT category_id, name, parent_id, name AS path, 0 AS depth
  FROM fx_category WHERE parent_id IS NULL OR parent_id = ''
  UNION ALL
  SELECT c.category_id, c.name, c.parent_id, CONCAT(t.path, ' > ', c.name) AS path, t.depth + 1 AS depth
  FROM fx_category c JOIN cat_tree t ON c.parent_id = t.category_id
  WHERE t.depth < 8)
SELECT * FROM cat_tree""")
def q_v9(spark, sf):
    return v.category_hierarchy(td.dim_category(spark, sf))


@register("V10_panel_continuity", f"""
SELECT f.customer_sk, COUNT(DISTINCT f.sale_date) AS active_days,
       COUNT(DISTINCT f.product_sk) AS distinct_products, SUM(f.line_total) AS total_spend
FROM fx_fact_sales f
JOIN fx_dim_customer c ON c.customer_sk = f.customer_sk
 AND {norm_country_sql('c.country')} = {norm_country_sql('f.country')}
WHERE f.sale_date >= {days_back(S, 90)}
GROUP BY f.customer_sk""")
def q_v10(spark, sf):
    return v.panel_continuity(td.fact_sales(spark, sf), td.dim_customer(spark, sf), S)


@register("V11_otd_by_carrier", f"""
SELECT carrier, COUNT(*) AS shipments,
  round(AVG(CASE WHEN delivered_ts <= shipped_ts + INTERVAL 48 HOUR THEN 1.0 ELSE 0.0 END), 6) AS otd_rate,
  round(AVG(date_diff('second', shipped_ts, delivered_ts)) / 3600.0, 6) AS avg_transit_hours
FROM fx_shipments
WHERE CAST(shipped_ts AS DATE) >= {days_back(SH, 30)}
GROUP BY carrier""")
def q_v11(spark, sf):
    return v.otd_by_carrier(td.fact_shipments(spark, sf), SH)


@register("V12_omniture", """
SELECT event_ts, ip, url, user_id, city, country, state, date_ts FROM fx_omniture""")
def q_v12(spark, sf):
    return v.omniture(td.omniture_logs(spark, sf))


@register("V13_fraud_signals_recent", f"""
SELECT customer_id, signal_type, score, risk_band, reason_codes, signal_ts, vendor, signal_date
FROM fx_fraud_signals
WHERE signal_date >= strftime({days_back(E, 1)}, '%Y%m%d')""")
def q_v13(spark, sf):
    return v.fraud_recent(td.fraud_signals(spark, sf), E)


@register("V14_returns_pending", f"""
SELECT rma_id, customer_id, invoice_no, stock_code, quantity, requested_at,
       date_diff('day', CAST(requested_at AS DATE), {date_lit(R)}) AS days_pending
FROM fx_rma WHERE approved IS NULL OR approved = FALSE""")
def q_v14(spark, sf):
    return v.returns_pending(td.return_authorizations(spark, sf), R)


@register("U1_normalize_country", f"""
SELECT raw_country, {norm_country_sql('raw_country')} AS country_code
FROM (SELECT country AS raw_country FROM fx_dim_customer
      UNION SELECT country FROM fx_fact_sales) t""")
def q_u1(spark, sf):
    raw = (td.dim_customer(spark, sf).select(F.col("country").alias("raw_country"))
           .union(td.fact_sales(spark, sf).select("country")).distinct())
    return raw.select("raw_country", normalize_country(F.col("raw_country")).alias("country_code"))
