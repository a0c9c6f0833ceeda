"""Registered queries for the data-driven dimension and fact loads."""

from __future__ import annotations

from ..oracle_fixtures import _pick
from ..registry import register
from ..sources import testdata as td
from . import loads as ld
from .catalog_state import _TERMS_SNAP

_TWICE = "(VALUES (0), (1)) d(delivery)"


def _fee_sql(part: int, kind: str, quote: str = "") -> str:
    return f"CAST(CASE tender_type {' '.join(f'WHEN {chr(39)}{t}{chr(39)} THEN {quote}{f[part]}{quote}' for t, f in ld.TENDER_FEES.items())} END AS {kind})"


# Feeds: delivery, natural key, attributes.
_FEEDS = {
    "dim_brand": """
  SELECT CASE feed_date WHEN '20010201' THEN 1 ELSE 0 END AS delivery, upper(trim(subcategory)) AS brand_id,
         MAX(trim(subcategory)) AS brand_name, MIN(available_from) AS launch_dt FROM fx_catalog GROUP BY 1, 2""",
    "dim_color": """
  SELECT CASE feed_date WHEN '20010201' THEN 1 ELSE 0 END AS delivery, lower(trim(color)) AS color_code, MAX(trim(color)) AS color_name
  FROM fx_catalog GROUP BY 1, 2""",
    "dim_size": """
  SELECT CASE feed_date WHEN '20010201' THEN 1 ELSE 0 END AS delivery, trim(size) AS size_code, MAX('Size ' || trim(size)) AS size_name,
         MAX(CAST(trim(size) AS BIGINT)) AS sort_order FROM fx_catalog GROUP BY 1, 2""",
    "dim_supplier": f"""
  SELECT delivery, 'SUP' || CAST(s_suppkey AS VARCHAR) AS supplier_id, s_name AS supplier_name, n_name AS country, payment_terms_days
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT supplier_sk, arg_max(payment_terms_days, eff_ts) AS payment_terms_days FROM ({_TERMS_SNAP}) t GROUP BY supplier_sk) x ON supplier_sk = s_suppkey,
  {_TWICE} WHERE delivery = 1 OR s_suppkey % 3 <> 0""",
    "dim_store": f"""
  SELECT delivery, store_id, store_name, store_type, region, country FROM fx_dim_store, {_TWICE} WHERE delivery = 1 OR store_sk % 2 = 0""",
    "dim_warehouse": f"""
  SELECT delivery, 'WH' || CAST(l_suppkey % 7 AS VARCHAR) AS warehouse_id, MAX('EMP' || CAST(l_suppkey % 13 AS VARCHAR)) AS operator,
         COUNT(DISTINCT l_partkey % 40) AS bins, CAST(MIN(l_shipdate + to_hours(CAST(l_partkey % 24 AS BIGINT))) AS DATE) AS open_dt
  FROM lineitem, {_TWICE}
  WHERE delivery = 1 OR l_shipdate + to_hours(CAST(l_partkey % 24 AS BIGINT)) < TIMESTAMP '{ld.WAREHOUSE_SPLIT.isoformat(sep=' ')}'
  GROUP BY 1, 2""",
    "dim_employee": f"""
  SELECT delivery, 'EMP' || CAST(n AS VARCHAR) AS employee_id, arg_max(role, yr) AS role, arg_max(department, yr) AS department,
         arg_max(home_store_sk, yr) AS home_store_sk, arg_max(salary_band, yr) AS salary_band, MIN(make_date(yr, 1, 1)) AS hire_dt
  FROM (SELECT n, yr, {_pick('(n + yr) % 3', td.EMPLOYEE_ROLES)} AS role, {_pick('home % 3', td.DEPARTMENTS)} AS department, home AS home_store_sk,
               'B' || CAST((yr - n) % 2 + 1 AS VARCHAR) AS salary_band
        FROM (SELECT o_orderkey % 13 AS n, year(o_orderdate) AS yr, CAST(substring(MIN('ST' || CAST(o_custkey % 10 AS VARCHAR)), 3) AS BIGINT) AS home
              FROM orders GROUP BY 1, 2) g) s, {_TWICE}
  WHERE delivery = 1 OR yr < {ld.EMPLOYEE_SPLIT} GROUP BY 1, 2""",
    "dim_payment_method": f"""
  SELECT delivery, tender_type AS method_code, lower(tender_type) AS method_name, {_fee_sql(0, 'VARCHAR', chr(39))} AS category,
         {_fee_sql(1, 'DECIMAL(5,4)')} AS fee_pct, {_fee_sql(2, 'DECIMAL(8,2)')} AS fee_flat
  FROM (SELECT DISTINCT tender_type FROM fx_pos) t, {_TWICE} WHERE delivery = 1 OR tender_type <> 'CASH'""",
    "dim_promotion": f"""
  SELECT delivery, promo_id, CAST(make_timestamp(MIN(valid_from_ts) * 1000) AS DATE) AS start_dt, CAST(make_timestamp(MAX(valid_to_ts) * 1000) AS DATE) AS end_dt
  FROM fx_promo_feed, {_TWICE} WHERE delivery = 1 OR ts < TIMESTAMP '{td.FEED_SPLIT.isoformat(sep=' ')}' GROUP BY 1, 2""",
    "dim_geography": f"""
  SELECT delivery, concat_ws('|', country_iso2, COALESCE(city, ''), COALESCE(postal_code, '')) AS place, country_iso2, city, postal_code, latitude, longitude
  FROM fx_geo, {_TWICE} WHERE delivery = 1 OR latitude < 0""",
    "dim_category": f"""
  SELECT delivery, category_id, parent_id, name FROM fx_category, {_TWICE} WHERE delivery = 1 OR COALESCE(parent_id, '') = ''""",
}


def _dimension_sql(name: str) -> str:
    """Keys in order of the natural key: first those of the first delivery."""
    spec = ld.DIMENSIONS[name]
    values = ", ".join(f"CASE WHEN b.{spec.natural} IS NOT NULL THEN b.{x} ELSE a.{x} END AS {x}" for x in spec.attrs)
    return f"""
  SELECT ROW_NUMBER() OVER (ORDER BY a.{spec.natural} IS NULL, COALESCE(a.{spec.natural}, b.{spec.natural})) AS {spec.sk},
         COALESCE(a.{spec.natural}, b.{spec.natural}) AS {spec.natural}, {values}
  FROM (SELECT * FROM ({_FEEDS[name]}) f WHERE delivery = 0) a
  FULL OUTER JOIN (SELECT * FROM ({_FEEDS[name]}) f WHERE delivery = 1) b ON a.{spec.natural} = b.{spec.natural}"""


def _query(name: str):
    def run(spark, sf):
        return ld.dimension(spark, sf, name)
    run.__name__ = f"q_{name}"
    return run


for _name in ld.DIMENSIONS:
    register(f"D3_{_name}", _dimension_sql(_name))(_query(_name))


_PAYMENTS_SQL = f"""
  SELECT p.txn_id AS payment_id, p.invoice_no, c.customer_sk, m.payment_method_sk, p.amount, 'USD' AS currency_code, p.txn_ts AS payment_ts,
         CAST(((CAST(p.amount * 100 AS HUGEINT) * CAST(m.fee_pct * 10000 AS HUGEINT) + 5000) // 10000) * 0.01 + m.fee_flat AS DECIMAL(10,2)) AS fee_amount,
         CAST(year(p.txn_ts) AS BIGINT) AS post_year, CAST(month(p.txn_ts) AS BIGINT) AS post_month, p.tender_type AS payment_method_partition,
         CAST(date_trunc('month', p.txn_ts) AS DATE) AS _partition_month
  FROM (SELECT *, CAST(gross_amount - discount_amount + tax_amount AS DECIMAL(14,2)) AS amount FROM fx_pos WHERE NOT COALESCE(void_flag, FALSE)) p
  LEFT JOIN fx_dim_customer c ON c.customer_id = p.customer_id
  LEFT JOIN ({_dimension_sql('dim_payment_method')}) m ON m.method_code = p.tender_type"""


def _payments(spark, sf, methods):
    return ld.fact_payments(td.pos_transactions(spark, sf), td.dim_customer(spark, sf), methods)


@register("F10c_fact_payments", _PAYMENTS_SQL)
def q_f10c(spark, sf):
    return _payments(spark, sf, ld.dimension(spark, sf, "dim_payment_method"))


@register("F10d_fact_warehouse_picks", f"""
SELECT l_orderkey * 8 + l_linenumber AS pick_id, w.warehouse_sk, e.employee_sk AS picker_sk, 'SKU' || CAST(l_partkey AS VARCHAR) AS sku,
       CAST(l_quantity AS BIGINT) AS quantity, l_shipdate + to_hours(CAST(l_suppkey % 24 AS BIGINT)) AS picked_ts,
       CAST(20000 + (l_partkey % 97) * 1000 AS BIGINT) AS duration_ms, 'BIN' || CAST(l_partkey % 40 AS VARCHAR) AS bin_location,
       'WH' || CAST(l_suppkey % 7 AS VARCHAR) AS warehouse_partition, CAST(l_shipdate + to_hours(CAST(l_suppkey % 24 AS BIGINT)) AS DATE) AS pick_date
FROM lineitem LEFT JOIN ({_dimension_sql('dim_warehouse')}) w ON w.warehouse_id = 'WH' || CAST(l_suppkey % 7 AS VARCHAR)
LEFT JOIN ({_dimension_sql('dim_employee')}) e ON e.employee_id = 'EMP' || CAST(l_orderkey % 13 AS VARCHAR)""")
def q_f10d(spark, sf):
    return ld.fact_warehouse_picks(td.warehouse_picks(spark, sf), ld.dimension(spark, sf, "dim_warehouse"), ld.dimension(spark, sf, "dim_employee"))


@register("F10e_fact_inventory_movements", f"""
SELECT l_orderkey * 8 + l_linenumber AS movement_id, ts AS movement_ts, 'SKU' || CAST(l_partkey AS VARCHAR) AS sku, w.warehouse_sk,
       CASE WHEN l_linestatus = 'O' THEN 'IN' ELSE 'OUT' END AS movement_type, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(l_orderkey AS VARCHAR) AS reference_doc, e.employee_sk AS operator_sk, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month,
       CAST(day(ts) AS BIGINT) AS day, CAST(ts AS DATE) AS _partition_date
FROM (SELECT *, l_shipdate + to_hours(CAST(l_partkey % 24 AS BIGINT)) AS ts FROM lineitem) l
LEFT JOIN ({_dimension_sql('dim_warehouse')}) w ON w.warehouse_id = 'WH' || CAST(l_suppkey % 7 AS VARCHAR)
LEFT JOIN ({_dimension_sql('dim_employee')}) e ON e.employee_id = 'EMP' || CAST(l_suppkey % 13 AS VARCHAR)""")
def q_f10e(spark, sf):
    return ld.fact_inventory_movements(td.inventory_movements(spark, sf), ld.dimension(spark, sf, "dim_warehouse"), ld.dimension(spark, sf, "dim_employee"))


@register("F10f_fact_refunds", f"""
SELECT r.invoice_no, r.product_sk, p.payment_id, p.customer_sk, CAST(r.refund_amount AS DECIMAL(14,2)) AS amount, p.currency_code,
       r.return_ts AS refund_ts, p.payment_method_partition AS refund_method, r.return_date AS refund_date
FROM fx_returns r LEFT JOIN ({_PAYMENTS_SQL}) p ON p.invoice_no = r.invoice_no""")
def q_f10f(spark, sf):
    methods = ld.dimension(spark, sf, "dim_payment_method")
    return ld.fact_refunds(td.fact_returns(spark, sf), _payments(spark, sf, methods), methods)
