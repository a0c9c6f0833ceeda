"""Registered queries for the state jobs (C1-C8, K1-K4, S7) with oracles.

Each query replays the derived change feed in two runs (before and after
``FEED_SPLIT``), merging the second run into the state the first produced,
so the merge path itself is what is checked against the oracle's one-shot
"latest per key" answer.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.merge import history_id
from ..oracle_fixtures import K, date_lit
from ..registry import register
from ..session import scratch_table
from ..sources import testdata as td
from ..sources.bucketed_state import apply_batch
from . import state as st

SPLIT = td.FEED_SPLIT
SPLIT_SQL = f"TIMESTAMP '{SPLIT.isoformat(sep=' ')}'"


def _two_runs(spark, feed, start_cols, merge, ts="ts"):
    b1 = feed.filter(F.col(ts) < F.lit(SPLIT))
    b2 = feed.filter(F.col(ts) >= F.lit(SPLIT))
    s1 = merge(st.empty_like(feed, start_cols), b1)
    return merge(s1, b2)


@register("C1_returns_ledger", """
SELECT return_id, invoice_no, customer_sk, return_ts, refund_amount, reason_code, status
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY return_id ORDER BY return_ts DESC) AS rn
      FROM fx_change_log) t
WHERE rn = 1 AND op <> 'D'""")
def q_c1(spark, sf):
    cdc = td.change_log(spark, sf)
    out = _two_runs(spark, cdc, st.LEDGER_COLS, st.apply_returns_cdc, ts="return_ts")
    return st.apply_returns_cdc(out, cdc.filter(F.col("return_ts") >= F.lit(SPLIT)))  # replay: no-op


@register("C1b_returns_ledger_bucketed_state", """
SELECT return_id, invoice_no, customer_sk, return_ts, refund_amount, reason_code, status
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY return_id ORDER BY return_ts DESC) AS rn
      FROM fx_change_log) t
WHERE rn = 1 AND op <> 'D'""")
def q_c1b(spark, sf):
    """Weeks out of order, then every one of them again."""
    from ..streaming.jobs import merge_cdc, read_ledger, stored_ledger_schema
    cdc = td.change_log(spark, sf)
    schema, root = stored_ledger_schema(cdc), scratch_table(spark, "ledger")
    week = F.pmod(F.floor(F.unix_seconds(F.col("return_ts").cast("timestamp")) / (7 * 86400)), F.lit(4))
    for number, k in enumerate((2, 0, 3, 1, 0, 1, 2, 3)):
        apply_batch(root, schema, ["return_id"], cdc.filter(week == k), number, merge_cdc)
    return read_ledger(spark, root, cdc)


@register("S7_merged_returns_cdc", """
SELECT return_id, invoice_no, customer_sk, return_ts, refund_amount, reason_code, status,
       op = 'D' AS is_deleted, snapshot_date
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY return_id, snapshot_date ORDER BY return_ts DESC) AS rn
      FROM fx_change_log) t
WHERE rn = 1""")
def q_s7(spark, sf):
    return st.merged_returns_cdc(td.change_log(spark, sf))


_C2_SQL = """
WITH s AS (
  SELECT *, LAG(ROW(address_line1, address_city, address_region, address_country, address_postal))
              OVER (PARTITION BY customer_sk ORDER BY ts) AS prev
  FROM fx_address),
c AS (
  SELECT * FROM s
  WHERE prev IS NULL
     OR prev IS DISTINCT FROM ROW(address_line1, address_city, address_region, address_country, address_postal)),
v AS (
  SELECT *, LEAD(ts) OVER (PARTITION BY customer_sk ORDER BY ts) AS eff_to,
         ROW_NUMBER() OVER (PARTITION BY customer_sk ORDER BY ts) AS version
  FROM c)
SELECT customer_sk * 1000000 + version AS history_id, customer_sk, address_line1, address_city,
       address_region, address_country, address_postal, ts AS eff_from, eff_to,
       eff_to IS NULL AS is_current,
       CASE WHEN prev IS NULL THEN 'new' ELSE 'address_change' END AS change_reason
FROM v"""


@register("C2_customer_address_history", _C2_SQL)
def q_c2(spark, sf):
    return st.customer_address_history(td.address_snapshots(spark, sf))


@register("C2b_address_history_incremental", _C2_SQL)
def q_c2b(spark, sf):
    return st.customer_address_history_incremental(td.address_snapshots(spark, sf), SPLIT)


@register("C2c_address_history_any_order", _C2_SQL)
def q_c2c(spark, sf):
    snapshots = td.address_snapshots(spark, sf)
    turn = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")) / 1000, F.lit(3)).cast("int")
    batches = [snapshots.filter(turn == k) for k in (1, 0, 2)]  # interleaved in time
    return st.customer_address_history_spliced([*batches, batches[0]])  # the first again: no change


@register("C6_loyalty_points_ledger", """
SELECT event_id AS entry_id, member_id,
       CASE WHEN event_type = 'EARN' THEN points ELSE -points END AS points_delta,
       SUM(CASE WHEN event_type = 'EARN' THEN points ELSE -points END)
         OVER (PARTITION BY member_id ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS running_balance,
       event_ts, event_type, CAST(event_id AS VARCHAR) AS reference_id,
       CASE WHEN event_type = 'EARN' THEN event_ts + INTERVAL 365 DAY END AS expiry_ts
FROM fx_loyalty""")
def q_c6(spark, sf):
    return st.loyalty_points_ledger(td.fact_loyalty_events(spark, sf))


@register("C7_inventory_adjustments_log", """
SELECT *, date_diff('minute', adjusted_at, approved_at) AS approval_lag_minutes,
       approved_by = adjusted_by AS self_approved, approved_by IS NULL AS pending
FROM fx_adjustments""")
def q_c7(spark, sf):
    adj = td.inventory_adjustments(spark, sf)
    b1 = adj.filter(F.col("adjusted_at") < F.lit(SPLIT))
    b2 = adj.filter(F.col("adjusted_at") >= F.lit(SPLIT))
    log = st.append_adjustments(st.append_adjustments(st.empty_like(adj, adj.columns), b1), b2)
    return st.adjustment_audit(st.append_adjustments(log, b2))  # replayed batch adds nothing


@register("C8_sales_as_of_address", f"""
WITH h AS ({_C2_SQL})
SELECT f.invoice_no, f.customer_sk, f.invoice_ts, f.line_total, h.history_id, h.address_city
FROM fx_app_sales f
LEFT JOIN h ON h.customer_sk = f.customer_sk AND h.eff_from <= f.invoice_ts
           AND (h.eff_to IS NULL OR f.invoice_ts < h.eff_to)""")
def q_c8(spark, sf):
    return st.sales_with_address(td.app_sales(spark, sf),
                                 st.customer_address_history(td.address_snapshots(spark, sf)))


@register("K1_inventory_realtime", """
SELECT warehouse_id, sku, on_hand, allocated, on_hand - allocated AS available, last_updated_ts
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY warehouse_id, sku ORDER BY last_updated_ts DESC) AS rn
      FROM fx_inventory_feed) t WHERE rn = 1""")
def q_k1(spark, sf):
    feed = td.inventory_feed(spark, sf)
    cols = ["warehouse_id", "sku", "on_hand", "allocated", "last_updated_ts"]
    return _two_runs(spark, feed, cols, lambda s, b: st.inventory_realtime(s, b).select(*cols)) \
        .withColumn("available", F.col("on_hand") - F.col("allocated")) \
        .select("warehouse_id", "sku", "on_hand", "allocated", "available", "last_updated_ts")


@register("K2_session_state", """
SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id,
       CAST(user_id AS VARCHAR) AS user_id,
       MIN((epoch_us(ts) // 1000)) AS started_ts, MAX((epoch_us(ts) // 1000)) AS last_event_ts,
       CAST(COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(10,2)) END), 0)
            AS DECIMAL(12,2)) AS cart_value,
       COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS cart_items,
       arg_max(event_type, ts) AS current_screen,
       CASE WHEN user_id % 2 = 0 THEN 'ios' ELSE 'android' END AS platform,
       CASE user_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' ELSE 'DE' END AS geo_country
FROM events GROUP BY user_id, strftime(ts, '%Y%m%d')""")
def q_k2(spark, sf):
    return st.session_state(spark.read.parquet(f"{sf}/events.parquet"))


@register("K2b_session_state_of_feed", f"""
WITH e AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, CAST(user_id AS VARCHAR) AS user_id,
         epoch_us(ts) // 1000 AS ms, CAST(event_id AS VARCHAR) AS event_id, event_type,
         CASE WHEN user_id % 2 = 0 THEN 'ios' ELSE 'android' END AS platform,
         CASE WHEN event_type = 'click' THEN 1 + {K} % 3 ELSE 0 END AS units, CAST(value AS DECIMAL(10,2)) AS price
  FROM events WHERE event_type IN ('click', 'view'))
SELECT session_id, arg_max(user_id, (ms, event_id)) AS user_id, MIN(ms) AS started_ts, MAX(ms) AS last_event_ts,
       CAST(SUM(units * price) AS DECIMAL(12,2)) AS cart_value, CAST(SUM(units) AS BIGINT) AS cart_items,
       arg_max(event_type, (ms, event_id)) AS current_screen, arg_max(platform, (ms, event_id)) AS platform, 'US' AS geo_country
FROM e GROUP BY session_id""")
def q_k2b(spark, sf):
    return st.session_state_of_feed(td.mobile_events(spark, sf))


PROMO_AT = dt.datetime(2024, 1, 25)


@register("K3_promo_eligibility_active", f"""
SELECT customer_id, promo_id, eligible, eligibility_reason, valid_from_ts, valid_to_ts, redeemed
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id, promo_id ORDER BY valid_from_ts DESC) AS rn
      FROM fx_promo_feed) t
WHERE rn = 1 AND eligible AND valid_from_ts <= (epoch_us(TIMESTAMP '{PROMO_AT.isoformat(sep=' ')}') // 1000)
  AND valid_to_ts > (epoch_us(TIMESTAMP '{PROMO_AT.isoformat(sep=' ')}') // 1000)""")
def q_k3(spark, sf):
    feed = td.promo_feed(spark, sf)
    return st.active_promos(_two_runs(spark, feed, st.PROMO_COLS, st.promo_eligibility), PROMO_AT)


@register("K4_realtime_price", """
SELECT sku, store_id, price, list_price, cost,
       CASE WHEN price = 0 THEN NULL ELSE
         CAST(sign(price - cost) * ((2 * abs(CAST((price - cost) * 100 AS HUGEINT)) * 10000 + CAST(price * 100 AS HUGEINT))
              // (2 * CAST(price * 100 AS HUGEINT))) AS DECIMAL(38,0)) * 0.0001 END AS margin_pct,
       updated_ts, pricing_engine
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku, store_id ORDER BY updated_ts DESC) AS rn
      FROM fx_price_feed) t WHERE rn = 1""")
def q_k4(spark, sf):
    feed = td.price_feed(spark, sf)
    state = _two_runs(spark, feed, st.PRICE_COLS, lambda s, b: st.realtime_price(s, b).select(*st.PRICE_COLS))
    return st.realtime_price(state, st.empty_like(feed, st.PRICE_COLS))


def _scd2_sql(snap_sql: str, key: str, attrs: list[str], ts: str, extra: str = "") -> str:
    row = ", ".join(attrs)
    return f"""
WITH snap AS ({snap_sql}),
s AS (SELECT *, LAG(ROW({row})) OVER (PARTITION BY {key} ORDER BY {ts}) AS prev FROM snap),
c AS (SELECT * FROM s WHERE prev IS NULL OR prev IS DISTINCT FROM ROW({row})),
v AS (SELECT *, LEAD({ts}) OVER (PARTITION BY {key} ORDER BY {ts}) AS eff_to,
             ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {ts}) AS version FROM c)
SELECT {key} * 1000000 + version AS history_id, {key}, {row}, {ts} AS eff_from, eff_to,
       eff_to IS NULL AS is_current, CASE WHEN prev IS NULL THEN 'new' ELSE 'changed' END AS change_reason{extra}
FROM v"""


_TERMS_SNAP = """
  SELECT supplier_sk, CAST(30 + ((supplier_sk + quarter(m)) % 3) * 15 AS BIGINT) AS payment_terms_days,
         CAST((supplier_sk + (month(m) - 1) // 6) % 4 AS DECIMAL(5,2)) AS discount_pct,
         CAST(m AS TIMESTAMP) AS eff_ts, 'EMP' || CAST(supplier_sk % 13 AS VARCHAR) AS changed_by
  FROM (SELECT DISTINCT l_suppkey AS supplier_sk, CAST(date_trunc('month', l_shipdate) AS DATE) AS m FROM lineitem) x"""


@register("C3_supplier_terms_history",
          _scd2_sql(_TERMS_SNAP, "supplier_sk", ["payment_terms_days", "discount_pct"], "eff_ts", ", changed_by"))
def q_c3(spark, sf):
    h = st.scd2_table("acid_supplier_terms_history", td.supplier_terms_snapshots(spark, sf), "eff_ts")
    return h.withColumn("history_id", history_id("supplier_sk")).select(
        "history_id", "supplier_sk", "payment_terms_days", "discount_pct", "eff_from", "eff_to", "is_current",
        "change_reason", "changed_by")


_STORE_SNAP = """
  SELECT store_sk,
         CASE (store_sk + year(m)) % 3 WHEN 0 THEN 'flagship' WHEN 1 THEN 'mall' ELSE 'outlet' END AS store_type,
         CAST(substring(mgr, 4) AS BIGINT) AS manager_employee_sk,
         CAST(1000 + (store_sk % 5) * 500 + (year(m) % 2) * 250 AS BIGINT) AS sq_ft, m AS eff_date
  FROM (SELECT CAST(o_custkey % 10 AS BIGINT) AS store_sk, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
               MIN('EMP' || CAST(o_orderkey % 13 AS VARCHAR)) AS mgr
        FROM orders GROUP BY 1, 2) x"""


@register("C5_dim_store_history",
          _scd2_sql(_STORE_SNAP, "store_sk", ["store_type", "manager_employee_sk", "sq_ft"], "eff_date"))
def q_c5(spark, sf):
    h = st.scd2_table("dim_store_history", td.store_month_snapshots(spark, sf), "eff_date")
    return h.withColumn("history_id", history_id("store_sk")).select(
        "history_id", "store_sk", "store_type", "manager_employee_sk", "sq_ft", "eff_from", "eff_to", "is_current",
        "change_reason")
