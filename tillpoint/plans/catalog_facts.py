"""Registered queries for fact loads (F), dimensions (D) and bridges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.merge import history_id
from ..oracle_fixtures import K, date_lit
from ..registry import register
from ..sources import testdata as td
from . import facts as fx
from . import staging as sg
from . import views as v
from .catalog_staging import _S9_CHECKS, _purchase_txns
from .catalog_views import S

DIM_SPLIT = dt.datetime(1998, 1, 1)


@register("F1_fact_sales_load", """
SELECT r.invoice_no, c.customer_sk, p.product_sk, r.quantity, r.unit_price,
       CAST(r.quantity * r.unit_price AS DECIMAL(14,2)) AS line_total, r.country,
       r.ts AS invoice_ts, CAST(r.ts AS DATE) AS sale_date
FROM (SELECT *, COALESCE(try_strptime(invoice_date, '%Y-%m-%d %H:%M:%S'),
                         try_strptime(invoice_date, '%m/%d/%Y %H:%M')) AS ts FROM fx_sales_retail) r
LEFT JOIN fx_dim_customer c ON c.customer_id = r.customer_id
LEFT JOIN fx_dim_product p ON p.stock_code = r.stock_code""")
def q_f1(spark, sf):
    return fx.fact_sales_load(td.sales_retail(spark, sf), td.dim_customer(spark, sf), td.dim_product(spark, sf))


@register("F2_supplier_invoice_lines", """
WITH x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY invoice_no ORDER BY sku, qty, unit_price) - 1 AS pos
           FROM fx_invoice_lines)
SELECT ROW_NUMBER() OVER (ORDER BY l_orderkey, l_suppkey, pos) AS invoice_line_id, invoice_no, l_suppkey AS supplier_sk,
       sku, qty AS quantity, CAST(unit_price AS DECIMAL(12,4)) AS unit_cost,
       CAST(qty * unit_price AS DECIMAL(14,2)) AS line_total, 'USD' AS currency_code,
       CAST(CAST(d AS DATE) AS TIMESTAMP) AS received_ts, CAST(year(d) AS BIGINT) AS invoice_year,
       CAST(month(d) AS BIGINT) AS invoice_month, CAST(date_trunc('month', d) AS DATE) AS _partition_month,
       pos AS line_position
FROM x""")
def q_f2(spark, sf):
    return fx.fact_supplier_invoice_lines(td.supplier_invoices(spark, sf))


_S8_SQL = """
WITH t AS (SELECT *, upper(trim(carrier)) AS c, trim(split_part(last_location, ',', 1)) AS lc,
                  trim(split_part(last_location, ',', 2)) AS lr, trim(split_part(last_location, ',', 3)) AS lco
           FROM fx_tracking),
ev AS (
SELECT tracking_no, c AS carrier, 'SHIPPED' AS event_type, shipped_at AS event_ts, lc, lr, lco FROM t
WHERE shipped_at IS NOT NULL
UNION ALL
SELECT tracking_no, c, 'DELIVERED', delivered_at, lc, lr, lco FROM t WHERE delivered_at IS NOT NULL
UNION ALL
SELECT tracking_no, c, upper(trim(status)), COALESCE(delivered_at, shipped_at), lc, lr, lco FROM t
WHERE COALESCE(delivered_at, shipped_at) IS NOT NULL)"""


@register("F3_fact_shipments", _S8_SQL + """
SELECT tracking_no, MIN(carrier) AS carrier,
       MIN(CASE WHEN event_type = 'SHIPPED' THEN event_ts END) AS shipped_ts,
       MIN(CASE WHEN event_type = 'DELIVERED' THEN event_ts END) AS delivered_ts,
       list_sort(list({'ts': event_ts, 'status': event_type, 'location': concat_ws(', ', lc, lr, lco)}))
         AS tracking_events,
       CAST(year(MIN(CASE WHEN event_type = 'SHIPPED' THEN event_ts END)) AS BIGINT) AS ship_year,
       CAST(month(MIN(CASE WHEN event_type = 'SHIPPED' THEN event_ts END)) AS BIGINT) AS ship_month,
       CAST(day(MIN(CASE WHEN event_type = 'SHIPPED' THEN event_ts END)) AS BIGINT) AS ship_day,
       MIN(carrier) AS carrier_partition,
       CAST(MIN(CASE WHEN event_type = 'SHIPPED' THEN event_ts END) AS DATE) AS _partition_date
FROM ev GROUP BY tracking_no""")
def q_f3(spark, sf):
    return fx.fact_shipments_fold(sg.normalized_carrier_events(td.shipment_tracking(spark, sf)))


@register("F4_fact_email_engagement", """
SELECT send_id, CAST(substring(any_value(campaign_id), 4) AS BIGINT) AS campaign_sk,
       CAST(any_value(recipient) AS BIGINT) AS user_sk, 'click' AS event_type, MIN(clicked_at) AS event_ts,
       arg_min(click_url, clicked_at) AS link_url,
       list_sort(list({'ts': clicked_at, 'url': click_url})) AS clicks, CAST(MIN(clicked_at) AS DATE) AS event_date
FROM fx_clicks GROUP BY send_id""")
def q_f4(spark, sf):
    return fx.fact_email_engagement(td.email_campaign_clicks(spark, sf))


@register("F5_fact_web_session", """
SELECT strptime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, ip, url, user_id, city, state,
       CAST(strptime(event_ts, '%Y-%m-%d %H:%M:%S') AS DATE) AS event_date, country
FROM fx_omniture""")
def q_f5(spark, sf):
    return fx.fact_web_session(v.omniture(td.omniture_logs(spark, sf)))


@register("F7_fact_app_clicks", f"""
SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id, user_id AS user_sk, ts AS event_ts, event_type,
       CAST(NULL AS VARCHAR) AS screen, CAST({K} AS VARCHAR) AS target_id,
       map(['k', 'event_type'], [CAST({K} AS VARCHAR), event_type]) AS properties,
       {{'platform': CASE WHEN user_id % 2 = 0 THEN 'ios' ELSE 'android' END, 'version': '5.' || CAST(user_id % 4 AS VARCHAR),
         'model': CASE user_id % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'tablet' ELSE 'desktop' END}} AS device,
       CAST(ts AS DATE) AS event_date, CASE WHEN user_id % 2 = 0 THEN 'ios' ELSE 'android' END AS platform_partition
FROM events WHERE event_type IN ('click', 'view')""")
def q_f7(spark, sf):
    return fx.fact_app_clicks(td.mobile_events(spark, sf))


@register("F8_fact_fraud_decisions", """
WITH t AS (SELECT event_id AS txn_id, CAST(user_id AS VARCHAR) AS customer_id, ts AS txn_ts
           FROM events WHERE event_type = 'purchase'),
j AS (SELECT t.*, s.score, s.reason_codes FROM t
      LEFT JOIN fx_fraud_signals s ON s.customer_id = t.customer_id
            AND s.signal_ts BETWEEN t.txn_ts - INTERVAL 1 DAY AND t.txn_ts),
g AS (SELECT txn_id, customer_id, txn_ts, MAX(score) AS mx,
             list_sort(list_distinct(flatten(list(reason_codes) FILTER (WHERE reason_codes IS NOT NULL)))) AS sig
      FROM j GROUP BY txn_id, customer_id, txn_ts)
SELECT txn_id, CAST(customer_id AS BIGINT) AS customer_sk, CAST(mx AS DECIMAL(5,4)) AS fraud_score,
       CASE WHEN CAST(mx AS DECIMAL(5,4)) >= 0.8 THEN 'DECLINE' WHEN CAST(mx AS DECIMAL(5,4)) >= 0.5 THEN 'REVIEW'
            ELSE 'APPROVE' END AS decision,
       COALESCE(sig, CAST([] AS VARCHAR[])) AS rule_signals, txn_ts AS decided_ts, CAST(txn_ts AS DATE) AS decision_date
FROM g""")
def q_f8(spark, sf):
    return fx.fact_fraud_decisions(sg.fraud_scored(_purchase_txns(spark, sf), td.fraud_signals(spark, sf)))


@register("F9_fact_loyalty_events", _S9_CHECKS + """
SELECT CAST(tx_id AS BIGINT) AS event_id, member_id, event_type, pts_ AS points, s.store_sk, tx_id,
       ts_ AS event_ts,
       map_from_entries(list_transform(string_split(meta_raw, ';'),
                        lambda x: {'key': split_part(x, '=', 1), 'value': split_part(x, '=', 2)})) AS meta,
       CAST(ts_ AS DATE) AS event_date
FROM c LEFT JOIN fx_dim_store s ON s.store_id = c.store_id
WHERE ts_ IS NOT NULL AND pts_ IS NOT NULL AND ok_""")
def q_f9(spark, sf):
    return fx.fact_loyalty_load(sg.parsed_loyalty_events(td.loyalty_events_raw(spark, sf)), td.dim_store(spark, sf))


@register("F10_fact_returns_load", """
SELECT CAST(regexp_replace(rma_id, '[^0-9]', '', 'g') AS BIGINT) AS return_id, r.invoice_no, c.customer_sk,
       p.product_sk, requested_at AS return_ts, quantity, CAST(NULL AS DECIMAL(12,2)) AS refund_amount,
       CAST(NULL AS VARCHAR) AS reason_code, 'store' AS return_channel, CAST(NULL AS BIGINT) AS store_sk,
       CAST(requested_at AS DATE) AS return_date
FROM fx_rma r LEFT JOIN fx_dim_customer c ON c.customer_id = r.customer_id
LEFT JOIN fx_dim_product p ON CAST(p.product_sk AS VARCHAR) = r.stock_code""")
def q_f10(spark, sf):
    rma = td.return_authorizations(spark, sf).withColumn("reason_code", F.lit(None).cast("string"))
    prod = td.dim_product(spark, sf).withColumn("product_natural", F.col("product_sk").cast("string"))
    return fx.fact_returns_load(rma, td.dim_customer(spark, sf), prod)


@register("F10b_fact_returns_load_reasons", """
SELECT CAST(regexp_replace(rma_id, '[^0-9]', '', 'g') AS BIGINT) AS return_id, r.invoice_no, c.customer_sk,
       p.product_sk, requested_at AS return_ts, quantity, CAST(NULL AS DECIMAL(12,2)) AS refund_amount,
       'R' || CAST(CAST(r.stock_code AS BIGINT) % 5 AS VARCHAR) AS reason_code, 'store' AS return_channel,
       CAST(NULL AS BIGINT) AS store_sk, CAST(requested_at AS DATE) AS return_date
FROM fx_rma r LEFT JOIN fx_dim_customer c ON c.customer_id = r.customer_id
LEFT JOIN fx_dim_product p ON CAST(p.product_sk AS VARCHAR) = r.stock_code""")
def q_f10b(spark, sf):
    prod = td.dim_product(spark, sf).withColumn("product_natural", F.col("product_sk").cast("string"))
    return fx.fact_returns_load(td.return_authorizations(spark, sf), td.dim_customer(spark, sf), prod)


def _yn(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'Y' ELSE 'N' END"


def _sk(d: str) -> str:
    return f"CAST(date_diff('day', DATE '1900-01-01', {d}) + 2415021 AS BIGINT)"


_HOL = " OR ".join(f"(month(d) = {m} AND day(d) = {x})" for m, x in fx.HOLIDAYS)
_PHOL = " OR ".join(f"(month(d - 1) = {m} AND day(d - 1) = {x})" for m, x in fx.HOLIDAYS)
_FY = "CAST(d + INTERVAL 6 MONTH AS DATE)"
_A = date_lit(S)


@register("D1_dim_date", f"""
WITH span AS (SELECT CAST(MIN(o_orderdate) AS DATE) AS lo, CAST(MAX(o_orderdate) AS DATE) AS hi FROM orders),
c AS (SELECT CAST(gs AS DATE) AS d FROM span, generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) t(gs))
SELECT {_sk('d')} AS d_date_sk, strftime(d, '%Y%m%d') AS d_date_id, d AS d_date,
       CAST((year(d) - 1900) * 12 + month(d) - 1 AS BIGINT) AS d_month_seq,
       CAST(date_diff('day', DATE '1899-12-31', d) // 7 + 1 AS BIGINT) AS d_week_seq,
       CAST((year(d) - 1900) * 4 + quarter(d) - 1 AS BIGINT) AS d_quarter_seq,
       CAST(year(d) AS BIGINT) AS d_year, CAST(dayofweek(d) AS BIGINT) AS d_dow, CAST(month(d) AS BIGINT) AS d_moy,
       CAST(day(d) AS BIGINT) AS d_dom, CAST(quarter(d) AS BIGINT) AS d_qoy, CAST(year({_FY}) AS BIGINT) AS d_fy_year,
       CAST((year({_FY}) - 1900) * 4 + quarter({_FY}) - 1 AS BIGINT) AS d_fy_quarter_seq,
       dayname(d) AS d_day_name, {_yn(_HOL)} AS d_holiday, {_yn('dayofweek(d) IN (0, 6)')} AS d_weekend,
       {_yn(_PHOL)} AS d_following_holiday,
       {_sk("CAST(date_trunc('month', d) AS DATE)")} AS d_first_dom, {_sk('last_day(d)')} AS d_last_dom,
       {_sk("CAST(d - INTERVAL 12 MONTH AS DATE)")} AS d_same_day_ly,
       {_sk("CAST(d - INTERVAL 3 MONTH AS DATE)")} AS d_same_day_lq,
       {_yn(f'd = {_A}')} AS d_current_day,
       {_yn(f"date_diff('day', DATE '1899-12-31', d) // 7 = date_diff('day', DATE '1899-12-31', {_A}) // 7")}
         AS d_current_week,
       {_yn(f"date_trunc('month', d) = date_trunc('month', {_A})")} AS d_current_month,
       {_yn(f'year(d) = year({_A}) AND quarter(d) = quarter({_A})')} AS d_current_quarter,
       {_yn(f'year(d) = year({_A})')} AS d_current_year
FROM c""")
def q_d1(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate").alias("d"))
    return fx.calendar_for(o, "d", spark, S)


@register("D2_dim_customer_merge", f"""
WITH s AS (SELECT CAST(customer_sk AS VARCHAR) AS customer_id, invoice_ts, country FROM fx_fact_sales
           WHERE customer_sk IS NOT NULL),
a AS (SELECT customer_id, MIN(invoice_ts) AS f, MAX(invoice_ts) AS l, arg_max(country, invoice_ts) AS c
      FROM s GROUP BY customer_id),
first_ids AS (SELECT customer_id, ROW_NUMBER() OVER (ORDER BY customer_id) AS sk
              FROM (SELECT DISTINCT customer_id FROM s WHERE invoice_ts < TIMESTAMP '{DIM_SPLIT}') x),
new_ids AS (SELECT customer_id, (SELECT COALESCE(MAX(sk), 0) FROM first_ids) + ROW_NUMBER() OVER (ORDER BY customer_id) AS sk
            FROM (SELECT DISTINCT customer_id FROM s WHERE customer_id NOT IN (SELECT customer_id FROM first_ids)) y)
SELECT k.sk AS customer_sk, a.customer_id, a.c AS country, a.f AS first_seen_ts, a.l AS last_seen_ts
FROM a JOIN (SELECT * FROM first_ids UNION ALL SELECT * FROM new_ids) k ON k.customer_id = a.customer_id""")
def q_d2(spark, sf):
    s = td.fact_sales(spark, sf).filter(F.col("customer_sk").isNotNull()).select(
        F.col("customer_sk").cast("string").alias("customer_id"), "invoice_ts", "country")
    empty = spark.createDataFrame([], "customer_sk bigint, customer_id string, country string, "
                                      "first_seen_ts timestamp_ntz, last_seen_ts timestamp_ntz")
    first = fx.dim_customer_merge(empty, s.filter(F.col("invoice_ts") < F.lit(DIM_SPLIT))).checkpoint(eager=True)
    return fx.dim_customer_merge(first, s.filter(F.col("invoice_ts") >= F.lit(DIM_SPLIT)))


@register("D3_dim_product_type1", """
WITH v0 AS (SELECT sku, trim(name) AS description, msrp AS unit_price FROM fx_catalog
            WHERE feed_date = '20010101' AND CAST(substring(sku, 4) AS BIGINT) % 3 <> 0),
v1 AS (SELECT sku, trim(name) AS description, msrp AS unit_price FROM fx_catalog WHERE feed_date = '20010201'),
k0 AS (SELECT sku, ROW_NUMBER() OVER (ORDER BY sku) AS sk FROM v0),
k1 AS (SELECT sku, (SELECT COALESCE(MAX(sk), 0) FROM k0) + ROW_NUMBER() OVER (ORDER BY sku) AS sk
       FROM v1 WHERE sku NOT IN (SELECT sku FROM k0))
SELECT k.sk AS product_sk, v1.sku AS stock_code, v1.description, v1.unit_price
FROM v1 JOIN (SELECT * FROM k0 UNION ALL SELECT * FROM k1) k ON k.sku = v1.sku""")
def q_d3(spark, sf):
    feed = td.product_catalog_feed(spark, sf).select(
        F.col("sku").alias("stock_code"), F.trim("name").alias("description"), F.col("msrp").alias("unit_price"),
        "feed_date")
    v0 = feed.filter((F.col("feed_date") == "20010101")
                     & (F.substring("stock_code", 4, 20).cast("bigint") % 3 != 0)).drop("feed_date")
    v1 = feed.filter(F.col("feed_date") == "20010201").drop("feed_date")
    empty = spark.createDataFrame([], "product_sk bigint, stock_code string, description string, unit_price decimal(10,2)")
    attrs = ["description", "unit_price"]
    first = fx.type1_dimension(empty, v0, "stock_code", "product_sk", attrs).checkpoint(eager=True)
    return fx.type1_dimension(first, v1, "stock_code", "product_sk", attrs)


_CLV = """
WITH per_customer AS (
  SELECT c.customer_sk, c.customer_id, c.country,
         MAX(f.sale_date) AS last_order_date, COUNT(DISTINCT f.invoice_no) AS orders
  FROM fx_dim_customer c LEFT JOIN fx_fact_sales f ON f.customer_sk = c.customer_sk
  GROUP BY c.customer_sk, c.customer_id, c.country),
seg AS (SELECT customer_sk,
  CASE WHEN orders = 0 THEN 'never'
       WHEN date_diff('day', last_order_date, DATE '{a}') <= 30 THEN 'active'
       WHEN date_diff('day', last_order_date, DATE '{a}') <= 90 THEN 'warm'
       WHEN date_diff('day', last_order_date, DATE '{a}') <= 365 THEN 'cold'
       ELSE 'churned' END AS b FROM per_customer)""".replace("{a}", S.isoformat())


@register("B3_bridge_customer_segment", _CLV + f"""
SELECT customer_sk, 'RFM_' || upper(b) AS segment_id, upper(b[1]) || b[2:] AS segment_name,
       {_A} AS assigned_dt, CAST({_A} + INTERVAL 30 DAY AS DATE) AS expires_dt,
       CAST(CASE b {' '.join(f"WHEN '{k}' THEN {v}" for k, v in fx.SEGMENT_CONFIDENCE.items())} END AS DECIMAL(4,3))
         AS confidence,
       'rfm' AS source, {_A} AS snapshot_date
FROM seg""")
def q_b3(spark, sf):
    clv = v.customer_lifetime_value(td.dim_customer(spark, sf), td.fact_sales(spark, sf), S)
    return fx.bridge_customer_segment(clv, S)


# Segment named by each promotion's rule, by region key % 4.
PROMO_SEGMENTS = ["Active", "Warm", "Cold", "Churned"]


def _promotions(spark, sf):
    r = spark.read.parquet(f"{sf}/region.parquet")
    seg = F.element_at(F.array(*[F.lit(x) for x in PROMO_SEGMENTS]), (F.col("r_regionkey") % 4 + 1).cast("int"))
    return r.select(F.col("r_regionkey").cast("bigint").alias("promo_sk"),
                    F.create_map(F.lit("segment"), seg).alias("eligibility"),
                    F.lit(dt.date(2001, 1, 1)).alias("start_dt"),
                    F.when(F.col("r_regionkey") == 4, F.lit(dt.date(2001, 6, 30)))
                    .otherwise(F.lit(dt.date(2001, 12, 31))).alias("end_dt"))


@register("B4_bridge_promo_eligibility", _CLV + f""",
promo AS (SELECT CAST(r_regionkey AS BIGINT) AS promo_sk,
                 ['{"', '".join(PROMO_SEGMENTS)}'][r_regionkey % 4 + 1] AS seg,
                 DATE '2001-01-01' AS start_dt,
                 CASE WHEN r_regionkey = 4 THEN DATE '2001-06-30' ELSE DATE '2001-12-31' END AS end_dt
          FROM region)
SELECT s.customer_sk, p.promo_sk, TRUE AS eligible, 'segment:' || p.seg AS reason,
       p.start_dt AS valid_from, p.end_dt AS valid_to, {_A} AS load_date
FROM seg s JOIN promo p ON upper(s.b[1]) || s.b[2:] = p.seg
WHERE p.start_dt <= {_A} AND p.end_dt >= {_A}""")
def q_b4(spark, sf):
    clv = v.customer_lifetime_value(td.dim_customer(spark, sf), td.fact_sales(spark, sf), S)
    return fx.bridge_promo_eligibility(fx.bridge_customer_segment(clv, S), _promotions(spark, sf), S)


_ATTR_SQL = " UNION ALL ".join(
    f"SELECT sku, feed_date, '{a}' AS attribute_name, lower(trim({a})) AS attribute_value FROM fx_catalog"
    for a in fx.PRODUCT_ATTRIBUTES)


@register("B1_bridge_product_attribute", f"""
WITH u AS ({_ATTR_SQL}),
g AS (SELECT sku, attribute_name, attribute_value, MAX(feed_date) AS last FROM u
      WHERE attribute_value IS NOT NULL GROUP BY sku, attribute_name, attribute_value)
SELECT CAST(substring(sku, 4) AS BIGINT) AS product_sk, attribute_name, attribute_value,
       ROW_NUMBER() OVER (PARTITION BY sku, attribute_name ORDER BY last DESC, attribute_value) = 1 AS primary_value,
       CAST(list_position([{", ".join("'" + x + "'" for x in fx.PRODUCT_ATTRIBUTES)}], attribute_name) AS BIGINT)
         AS sort_order
FROM g""")
def q_b1(spark, sf):
    return fx.bridge_product_attribute(td.product_catalog_feed(spark, sf))


_EMP_SQL = f"""
WITH p AS (
  SELECT 'EMP' || CAST(o_orderkey % 13 AS VARCHAR) AS cashier_id, 'ST' || CAST(o_custkey % 10 AS VARCHAR) AS store_id,
         year(o_orderdate) AS yr
  FROM orders),
g AS (SELECT cashier_id, yr, MIN(store_id) AS store_id, COUNT(*) AS txns FROM p GROUP BY cashier_id, yr),
snap AS (
  SELECT CAST(substring(cashier_id, 4) AS BIGINT) AS employee_sk, yr, txns,
         ['{"', '".join(td.EMPLOYEE_ROLES)}'][(CAST(substring(cashier_id, 4) AS BIGINT) + yr) % 3 + 1] AS role,
         ['{"', '".join(td.DEPARTMENTS)}'][CAST(substring(store_id, 3) AS INTEGER) % 3 + 1] AS department,
         CAST(substring(store_id, 3) AS BIGINT) AS home_store_sk,
         'B' || CAST((yr - CAST(substring(cashier_id, 4) AS BIGINT)) % 2 + 1 AS VARCHAR) AS salary_band,
         make_date(CAST(yr AS INTEGER), 1, 1) AS eff_date
  FROM g)"""


@register("B5_bridge_employee_role", _EMP_SQL + """
SELECT employee_sk, role,
       ROW_NUMBER() OVER (PARTITION BY employee_sk ORDER BY SUM(txns) DESC, role) = 1 AS primary_role,
       MIN(eff_date) AS eff_from, MAX(make_date(CAST(yr AS INTEGER), 12, 31)) AS eff_to
FROM snap GROUP BY employee_sk, role""")
def q_b5(spark, sf):
    return fx.bridge_employee_role(td.employee_year_snapshots(spark, sf))


@register("C4_dim_employee_history", _EMP_SQL + """,
s AS (SELECT *, LAG(ROW(role, department, home_store_sk, salary_band)) OVER (PARTITION BY employee_sk ORDER BY eff_date)
                 AS prev FROM snap),
c AS (SELECT * FROM s WHERE prev IS NULL OR prev IS DISTINCT FROM ROW(role, department, home_store_sk, salary_band)),
v AS (SELECT *, LEAD(eff_date) OVER (PARTITION BY employee_sk ORDER BY eff_date) AS eff_to,
             ROW_NUMBER() OVER (PARTITION BY employee_sk ORDER BY eff_date) AS version FROM c)
SELECT employee_sk * 1000000 + version AS history_id, employee_sk, role, department, home_store_sk, salary_band,
       eff_date AS eff_from, eff_to, eff_to IS NULL AS is_current,
       CAST(year(eff_date) AS BIGINT) AS eff_from_year, CAST(date_trunc('year', eff_date) AS DATE) AS _partition_year
FROM v""")
def q_c4(spark, sf):
    from . import state as st
    snaps = td.employee_year_snapshots(spark, sf).drop("yr", "txns")
    h = st.scd2_table("dim_employee_history", snaps, "eff_date")
    return h.withColumn("history_id", history_id("employee_sk")).select(
        "history_id", "employee_sk", "role", "department", "home_store_sk", "salary_band", "eff_from", "eff_to",
        "is_current", "eff_from_year", "_partition_year")


@register("F6_fact_inventory_snapshot", """
WITH d AS (SELECT sku, warehouse_id, CAST(movement_ts AS DATE) AS snapshot_date,
                  SUM(CASE WHEN movement_type = 'IN' THEN quantity ELSE -quantity END) AS net,
                  MAX(movement_ts) AS last_movement_ts
           FROM fx_movements GROUP BY sku, warehouse_id, CAST(movement_ts AS DATE)),
r AS (SELECT *, SUM(net) OVER (PARTITION BY sku, warehouse_id ORDER BY snapshot_date ROWS UNBOUNDED PRECEDING) AS oh
      FROM d)
SELECT sku, CAST(substring(warehouse_id, 3) AS BIGINT) AS warehouse_sk, CAST(oh AS BIGINT) AS on_hand_units,
       CAST(0 AS BIGINT) AS allocated_units, CAST(0 AS BIGINT) AS in_transit_units,
       CAST(oh AS BIGINT) AS available_units, CAST(NULL AS DECIMAL(12,4)) AS avg_cost, last_movement_ts,
       snapshot_date
FROM r""")
def q_f6(spark, sf):
    return fx.fact_inventory_snapshot(td.inventory_movements(spark, sf))
