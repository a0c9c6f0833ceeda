"""Registered queries for the staging jobs S1-S10 and A7, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..oracle_fixtures import date_lit, hu_div
from ..registry import register
from ..sources import testdata as td
from . import staging as sg

L = td.STAGING_AS_OF
ADDR = "addr_line1, addr_city, addr_region, addr_country, addr_postal"


def _initcap(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


_S6_SQL = f"""
SELECT sha256(lower(concat_ws('|', a.addr_line1, a.addr_city, a.addr_region, a.addr_country, a.addr_postal))) AS raw_addr_hash,
       a.addr_line1, a.addr_city, a.addr_region, a.addr_country, a.addr_postal,
       COALESCE(gp.lat, gc.lat) AS lat, COALESCE(gp.lon, gc.lon) AS lon,
       CAST(CASE WHEN gp.lat IS NOT NULL THEN 0.95 WHEN gc.lat IS NOT NULL THEN 0.70 ELSE 0 END AS DECIMAL(4,3)) AS confidence,
       'lookup' AS provider, {date_lit(L)} AS load_date
FROM (SELECT DISTINCT {ADDR} FROM fx_addresses) a
LEFT JOIN (SELECT country_iso2, postal_code, min(latitude) AS lat, min(longitude) AS lon FROM fx_geo
           WHERE postal_code IS NOT NULL GROUP BY country_iso2, postal_code) gp
       ON gp.country_iso2 = a.addr_country AND gp.postal_code = a.addr_postal
LEFT JOIN (SELECT country_iso2, city, min(latitude) AS lat, min(longitude) AS lon FROM fx_geo
           WHERE postal_code IS NULL AND city IS NOT NULL GROUP BY country_iso2, city) gc
       ON gc.country_iso2 = a.addr_country AND gc.city = a.addr_city"""


@register("S1_cleansed_customers", f"""
WITH s AS (SELECT customer_id, lower(trim(email)) AS email_norm, regexp_replace(phone, '[^0-9]', '', 'g') AS phone_norm,
                  first_name, last_name, {ADDR}, signup_date FROM fx_signups),
n AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY signup_date DESC) AS rn FROM s) x
      WHERE rn = 1),
g AS ({_S6_SQL})
SELECT n.customer_id, email_norm, phone_norm, first_name, last_name, n.addr_line1, n.addr_city, n.addr_region,
       n.addr_country, n.addr_postal, g.lat AS geocoded_lat, g.lon AS geocoded_lon,
       strptime(signup_date, '%Y%m%d') AS eff_from_ts,
       sha256(concat_ws('|', email_norm, phone_norm, first_name, last_name, n.addr_line1, n.addr_city, n.addr_region,
                        n.addr_country, n.addr_postal)) AS record_hash,
       {date_lit(L)} AS load_date
FROM n LEFT JOIN g ON g.raw_addr_hash = sha256(lower(concat_ws('|', n.addr_line1, n.addr_city, n.addr_region,
                                                                n.addr_country, n.addr_postal)))""")
def q_s1(spark, sf):
    geo = sg.geocode(td.customer_addresses(spark, sf), td.dim_geography(spark, sf), L)
    return sg.cleansed_customers(td.customer_signups(spark, sf), geo, L)


@register("S2_cleansed_orders", """
SELECT 'POS-' || CAST(txn_id AS VARCHAR) AS order_id, customer_id, invoice_no, txn_ts, line_count, gross_amount,
       discount_amount AS discount, tax_amount AS tax,
       CAST(gross_amount - discount_amount + tax_amount AS DECIMAL(14,2)) AS net_amount,
       tender_type, 'pos' AS source_feed, CAST(txn_ts AS DATE) AS order_date
FROM fx_pos WHERE NOT COALESCE(void_flag, FALSE)""")
def q_s2(spark, sf):
    return sg.cleansed_orders(td.pos_transactions(spark, sf))


@register("S3_cleansed_products", f"""
WITH last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku ORDER BY feed_date DESC) AS rn
                             FROM fx_catalog) x WHERE rn = 1)
SELECT sku, upc, {_initcap("trim(regexp_replace(name, '\\s+', ' ', 'g'))")} AS name_norm,
       upper(trim(category)) AS category_norm, subcategory, lower(trim(color)) AS color_norm,
       upper(trim(size)) AS size_norm, msrp, cost, supplier_id,
       available_from <= {date_lit(L)} AND (discontinued_at IS NULL OR discontinued_at > {date_lit(L)}) AS available,
       {date_lit(L)} AS load_date
FROM last""")
def q_s3(spark, sf):
    return sg.cleansed_products(td.product_catalog_feed(spark, sf), L)


@register("S4_dedup_clickstream", f"""
WITH o AS (SELECT user_id, strptime(event_ts, '%Y-%m-%d %H:%M:%S') AS ts, url AS page_url, ip, country, date_ts
           FROM fx_omniture),
d AS (SELECT user_id, page_url, ts, min(ip) AS ip, min(country) AS country, min(date_ts) AS date_ts
      FROM o GROUP BY user_id, page_url, ts),
p AS (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, page_url) AS prev FROM d),
s AS (SELECT *, SUM(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, page_url ROWS UNBOUNDED PRECEDING) AS session_no FROM p),
st AS (SELECT user_id, session_no, COUNT(*) AS n, date_diff('second', MIN(ts), MAX(ts)) AS dur
       FROM s GROUP BY user_id, session_no)
SELECT s.user_id || '-' || CAST(s.session_no AS VARCHAR) AS session_id, s.user_id, ts AS event_ts, page_url,
       CAST(NULL AS VARCHAR) AS referrer_url, ip, country,
       LEAST({hu_div('n * 6', 'dur + 60', 3, out='DECIMAL(4,3)')}, 1) AS bot_score,
       CAST(NULL AS VARCHAR) AS device_type, date_ts, country AS country_partition
FROM s JOIN st ON s.user_id = st.user_id AND s.session_no = st.session_no""")
def q_s4(spark, sf):
    return sg.dedup_clickstream(td.omniture_logs(spark, sf).transform(
        lambda df: df.select(*[F.col(c).alias(a) for c, a in
                               [("col_2", "event_ts"), ("col_8", "ip"), ("col_13", "url"), ("col_14", "user_id"),
                                ("col_51", "country")]], "date_ts")))


def _purchase_txns(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").filter(F.col("event_type") == "purchase")
    return e.select(F.col("event_id").alias("txn_id"), F.col("user_id").cast("string").alias("customer_id"),
                    F.col("ts").alias("txn_ts"))


@register("S5_fraud_scored", """
WITH t AS (SELECT event_id AS txn_id, CAST(user_id AS VARCHAR) AS customer_id, ts AS txn_ts
           FROM events WHERE event_type = 'purchase'),
j AS (SELECT t.*, s.score, s.reason_codes FROM t
      LEFT JOIN fx_fraud_signals s ON s.customer_id = t.customer_id
            AND s.signal_ts BETWEEN t.txn_ts - INTERVAL 1 DAY AND t.txn_ts),
g AS (SELECT txn_id, customer_id, txn_ts, MAX(score) AS mx,
             list_sort(list_distinct(flatten(list(reason_codes) FILTER (WHERE reason_codes IS NOT NULL)))) AS sig
      FROM j GROUP BY txn_id, customer_id, txn_ts)
SELECT txn_id, customer_id, CAST(mx AS DECIMAL(5,4)) AS fraud_score,
       CASE WHEN mx >= 0.8 THEN 'HIGH' WHEN mx >= 0.5 THEN 'MEDIUM' WHEN mx IS NOT NULL THEN 'LOW' ELSE 'NONE' END
         AS risk_band,
       COALESCE(sig, CAST([] AS VARCHAR[])) AS signals, txn_ts AS scored_at, CAST(txn_ts AS DATE) AS score_date
FROM g""")
def q_s5(spark, sf):
    return sg.fraud_scored(_purchase_txns(spark, sf), td.fraud_signals(spark, sf))


@register("S6_geocoded_addresses", _S6_SQL)
def q_s6(spark, sf):
    return sg.geocode(td.customer_addresses(spark, sf), td.dim_geography(spark, sf), L)


@register("S8_normalized_carrier_events", """
WITH t AS (SELECT *, upper(trim(carrier)) AS c, trim(split_part(last_location, ',', 1)) AS lc,
                  trim(split_part(last_location, ',', 2)) AS lr, trim(split_part(last_location, ',', 3)) AS lco
           FROM fx_tracking)
SELECT tracking_no, c AS carrier, 'SHIPPED' AS event_type, shipped_at AS event_ts, lc AS location_city,
       lr AS location_region, lco AS location_country, date_ts FROM t WHERE shipped_at IS NOT NULL
UNION ALL
SELECT tracking_no, c, 'DELIVERED', delivered_at, lc, lr, lco, date_ts FROM t WHERE delivered_at IS NOT NULL
UNION ALL
SELECT tracking_no, c, upper(trim(status)), COALESCE(delivered_at, shipped_at), lc, lr, lco, date_ts FROM t
WHERE COALESCE(delivered_at, shipped_at) IS NOT NULL""")
def q_s8(spark, sf):
    return sg.normalized_carrier_events(td.shipment_tracking(spark, sf))


_S9_CHECKS = """
WITH c AS (SELECT *, try_strptime(event_ts_str, '%Y-%m-%d %H:%M:%S') AS ts_, TRY_CAST(points AS BIGINT) AS pts_,
                  COALESCE(regexp_full_match(meta_raw, '^[^=;]+=[^=;]*(;[^=;]+=[^=;]*)*$'), FALSE) AS ok_
           FROM fx_loyalty_raw)"""


@register("S9_parsed_loyalty_events", _S9_CHECKS + """
SELECT ts_ AS event_ts, member_id, event_type, pts_ AS points, store_id, tx_id,
       map_from_entries(list_transform(string_split(meta_raw, ';'),
                        lambda x: {'key': split_part(x, '=', 1), 'value': split_part(x, '=', 2)})) AS meta,
       date_ts
FROM c WHERE ts_ IS NOT NULL AND pts_ IS NOT NULL AND ok_""")
def q_s9(spark, sf):
    return sg.parsed_loyalty_events(td.loyalty_events_raw(spark, sf))


@register("S9b_loyalty_quarantine", _S9_CHECKS + """
SELECT event_ts_str, member_id, event_type, points, store_id, tx_id, meta_raw, date_ts,
       concat_ws(',', CASE WHEN ts_ IS NULL THEN 'bad_ts' END, CASE WHEN pts_ IS NULL THEN 'bad_points' END,
                 CASE WHEN NOT ok_ THEN 'bad_meta' END) AS reject_reason
FROM c WHERE ts_ IS NULL OR pts_ IS NULL OR NOT ok_""")
def q_s9b(spark, sf):
    return sg.loyalty_quarantine(td.loyalty_events_raw(spark, sf))


_S10_BASE = """
WITH m AS (SELECT warehouse_id, date_trunc('hour', movement_ts) AS snapshot_ts,
                  SUM(CASE WHEN movement_type = 'IN' THEN quantity END) AS i,
                  SUM(CASE WHEN movement_type = 'OUT' THEN quantity END) AS o
           FROM fx_movements GROUP BY warehouse_id, date_trunc('hour', movement_ts)),
p AS (SELECT warehouse_id, date_trunc('hour', picked_at) AS snapshot_ts, SUM(quantity) AS picked,
             SUM(duration_ms) AS ms, COUNT(*) AS n
      FROM fx_picks GROUP BY warehouse_id, date_trunc('hour', picked_at)),
j AS (SELECT COALESCE(m.warehouse_id, p.warehouse_id) AS warehouse_id, COALESCE(m.snapshot_ts, p.snapshot_ts) AS snapshot_ts,
             CAST(COALESCE(i, 0) AS BIGINT) AS units_in, CAST(COALESCE(picked, 0) AS BIGINT) AS units_picked,
             CAST(COALESCE(o, 0) AS BIGINT) AS units_shipped, ms, n
      FROM m FULL OUTER JOIN p ON m.warehouse_id = p.warehouse_id AND m.snapshot_ts = p.snapshot_ts),
k AS (SELECT *, CAST(SUM(units_in - units_shipped) OVER (PARTITION BY warehouse_id ORDER BY snapshot_ts
                                                        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS backlog_units FROM j)"""


@register("S10_warehouse_kpi_snapshot", _S10_BASE + """
SELECT warehouse_id, snapshot_ts, units_in, units_picked, units_shipped,
       CAST(units_picked AS DECIMAL(8,2)) AS pick_rate_uph, backlog_units, ms // n AS avg_pick_ms,
       strftime(snapshot_ts, '%Y%m%d') AS date_ts
FROM k""")
def q_s10(spark, sf):
    return sg.kpi_snapshot_table(sg.warehouse_kpi_snapshot(td.warehouse_picks(spark, sf),
                                                           td.inventory_movements(spark, sf)))


@register("A7_hourly_warehouse_kpi", _S10_BASE + f"""
SELECT CAST(substring(warehouse_id, 3, 10) AS BIGINT) AS warehouse_sk, units_in, units_picked, units_shipped,
       CAST(units_picked AS DECIMAL(8,2)) AS pick_rate_uph, backlog_units,
       {hu_div('ms', 'n * 1000', 2, out='DECIMAL(8,2)')} AS avg_pick_seconds,
       strftime(snapshot_ts, '%Y%m%d_%H') AS snapshot_hour,
       CAST(strptime(strftime(snapshot_ts, '%Y%m%d_%H'), '%Y%m%d_%H') AS DATE) AS _partition_date
FROM k""")
def q_a7(spark, sf):
    return sg.hourly_warehouse_kpi(sg.warehouse_kpi_snapshot(td.warehouse_picks(spark, sf),
                                                             td.inventory_movements(spark, sf)))
