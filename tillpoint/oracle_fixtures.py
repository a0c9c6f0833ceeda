"""DuckDB SQL for the derived retail inputs (the oracle side of
``sources/testdata.py``).  Each entry is a CTE body over the driver's
pre-registered views; :func:`with_fixtures` prepends only the CTEs a query
uses.  Money is rebuilt from exact cents, as on the Spark side.
"""

from __future__ import annotations

import re

from .sources import testdata as td


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(key: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {key} = {_q(k) if isinstance(k, str) else k} THEN {_q(v)}"
                     for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def _pick(idx: str, values: list[str]) -> str:
    return _case(idx, dict(enumerate(values)))


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _lit_date(d) -> str:
    return f"DATE '{d.isoformat()}'"


FIXTURES: dict[str, str] = {}

FIXTURES["fx_nation"] = f"""
  SELECT n_nationkey, n_name, n_regionkey,
         {_case('n_nationkey', {k: v[0] for k, v in td.NATION_SPELLINGS.items()}, 'n_name')} AS sales_country,
         {_case('n_nationkey', {k: v[1] for k, v in td.NATION_SPELLINGS.items()},
                'CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END')} AS customer_country
  FROM nation"""

FIXTURES["fx_fact_sales"] = """
  SELECT CAST(l.l_orderkey AS VARCHAR) AS invoice_no,
         o.o_custkey AS customer_sk,
         l.l_partkey AS product_sk,
         CAST(l.l_quantity AS BIGINT) AS quantity,
         CAST(CAST((2 * CAST(round(l.l_extendedprice * 100) AS BIGINT) + CAST(l.l_quantity AS BIGINT))
                   // (2 * CAST(l.l_quantity AS BIGINT)) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(10,2)) AS unit_price,
         CAST(CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
              AS DECIMAL(14,2)) AS line_total,
         n.sales_country AS country,
         o.o_orderdate AS invoice_ts,
         CAST(o.o_orderdate AS DATE) AS sale_date,
         l.l_suppkey AS store_sk
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN (customer c JOIN fx_nation n ON c.c_nationkey = n.n_nationkey) ON o.o_custkey = c.c_custkey"""

FIXTURES["fx_dim_customer"] = """
  SELECT c.c_custkey AS customer_sk, CAST(c.c_custkey AS VARCHAR) AS customer_id,
         CASE WHEN c.c_custkey % 13 = 0 THEN NULL
              WHEN c.c_custkey % 29 = 0 THEN 'Atlantis'
              ELSE n.customer_country END AS country
  FROM customer c LEFT JOIN fx_nation n ON c.c_nationkey = n.n_nationkey"""

FIXTURES["fx_dim_product"] = """
  SELECT p_partkey AS product_sk, 'SKU' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS stock_code,
         p_name AS description, CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price
  FROM part"""

FIXTURES["fx_dim_store"] = f"""
  SELECT s.s_suppkey AS store_sk, 'ST' || CAST(s.s_suppkey AS VARCHAR) AS store_id, s.s_name AS store_name,
         {_pick('s.s_suppkey % 3', ['flagship', 'mall', 'outlet'])} AS store_type,
         r.r_name AS region, n.n_name AS country
  FROM supplier s
  LEFT JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON s.s_nationkey = n.n_nationkey"""

FIXTURES["fx_dim_date"] = f"""
  SELECT CAST(date_diff('day', DATE '1900-01-01', d) + 2415021 AS BIGINT) AS d_date_sk,
         d AS d_date,
         CAST(date_diff('day', DATE '1899-12-31', d) // 7 + 1 AS BIGINT) AS d_week_seq,
         CAST(year(d) AS BIGINT) AS d_year
  FROM (SELECT CAST(gs AS DATE) AS d
        FROM generate_series({_lit_date(td.CALENDAR_START)}::TIMESTAMP,
                             {_lit_date(td.CALENDAR_END)}::TIMESTAMP, INTERVAL 1 DAY) t(gs))"""

FIXTURES["fx_mobile_events"] = f"""
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS event_ts, CAST(user_id AS VARCHAR) AS user_id,
         {_pick(f'{K} % 4', td.REFERRERS)} AS referrer
  FROM events WHERE event_type IN ('click', 'view')"""

FIXTURES["fx_app_sales"] = """
  SELECT 'E' || CAST(event_id AS VARCHAR) AS invoice_no, user_id AS customer_sk,
         CAST(value AS DECIMAL(14,2)) AS line_total, ts AS invoice_ts, CAST(ts AS DATE) AS sale_date
  FROM events WHERE event_type = 'purchase'"""

FIXTURES["fx_loyalty"] = """
  SELECT event_id, CAST(user_id AS VARCHAR) AS member_id,
         CASE WHEN event_type = 'click' THEN 'REDEEM' ELSE 'EARN' END AS event_type,
         CAST(floor(value) AS BIGINT) AS points, user_id % 10 AS store_sk,
         ts AS event_ts, CAST(ts AS DATE) AS event_date
  FROM events WHERE event_type IN ('click', 'purchase')"""

FIXTURES["fx_change_log"] = f"""
  SELECT user_id AS return_id, 'E' || CAST(event_id AS VARCHAR) AS invoice_no, user_id AS customer_sk,
         ts AS return_ts, CAST(value AS DECIMAL(12,2)) AS refund_amount,
         'R' || CAST({K} % 5 AS VARCHAR) AS reason_code, event_type AS status,
         {_case('event_type', td.CHANGE_OPS, "'U'")} AS op,
         CAST(ts AS DATE) AS snapshot_date, event_id, {K} AS k
  FROM events"""

FIXTURES["fx_fraud_signals"] = f"""
  SELECT CAST(user_id AS VARCHAR) AS customer_id,
         {_pick(f'{K} % 3', ['velocity', 'device', 'geo'])} AS signal_type,
         CAST({K} AS DOUBLE) / 100.0 AS score,
         CASE WHEN {K} >= 70 THEN 'HIGH' WHEN {K} >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
         ['RC' || CAST({K} % 5 AS VARCHAR), 'RC' || CAST({K} % 3 AS VARCHAR)] AS reason_codes,
         ts AS signal_ts,
         {_pick('user_id % 2', ['vendor_a', 'vendor_b'])} AS vendor,
         strftime(ts, '%Y%m%d') AS signal_date,
         CAST(ts AS DATE) AS _ingest_date
  FROM events WHERE event_type = 'error'"""

FIXTURES["fx_omniture"] = f"""
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_ts,
         '10.1.' || CAST(user_id % 250 AS VARCHAR) || '.' || CAST(event_id % 250 AS VARCHAR) AS ip,
         '/p/' || CAST({K} AS VARCHAR) AS url,
         CAST(user_id AS VARCHAR) AS user_id,
         'City' || CAST(user_id % 20 AS VARCHAR) AS city,
         {_pick('user_id % 3', ['US', 'GB', 'DE'])} AS country,
         'S' || CAST(user_id % 7 AS VARCHAR) AS state,
         strftime(ts, '%Y%m%d') AS date_ts
  FROM events"""

FIXTURES["fx_shipments"] = f"""
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS shipment_id,
         'TRK' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS tracking_no,
         CAST(l_orderkey AS VARCHAR) AS invoice_no,
         l_suppkey % 7 AS warehouse_sk,
         {_pick('l_suppkey % 5', td.CARRIERS)} AS carrier,
         l_shipdate AS shipped_ts,
         CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_shipdate + to_hours(CAST(l_partkey % 96 AS BIGINT)) END AS delivered_ts,
         CAST(48 AS BIGINT) AS sla_hours,
         CAST(l_shipdate AS DATE) AS _partition_date
  FROM lineitem"""

FIXTURES["fx_returns"] = """
  SELECT CAST(l_orderkey AS VARCHAR) AS invoice_no, l_partkey AS product_sk, l_suppkey AS store_sk,
         l_shipdate + to_days(CAST(l_partkey % 30 AS INTEGER)) AS return_ts,
         CAST(l_quantity AS BIGINT) AS quantity,
         CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2)) AS refund_amount,
         'R' || CAST(l_partkey % 5 AS VARCHAR) AS reason_code,
         CAST(l_shipdate + to_days(CAST(l_partkey % 30 AS INTEGER)) AS DATE) AS return_date
  FROM lineitem WHERE l_returnflag = 'R'"""

FIXTURES["fx_rma"] = """
  SELECT 'RMA-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS rma_id,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         CAST(l.l_orderkey AS VARCHAR) AS invoice_no,
         CAST(l.l_partkey AS VARCHAR) AS stock_code,
         CAST(l.l_quantity AS BIGINT) AS quantity,
         l.l_shipdate + to_days(CAST(l.l_partkey % 30 AS INTEGER)) + to_hours(CAST(l.l_suppkey % 24 AS BIGINT)) AS requested_at,
         CASE l.l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS approved
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_returnflag = 'R'"""

FIXTURES["fx_category"] = """
  SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS category_id,
         CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE '' END AS parent_id, r_name AS name
  FROM region
  UNION ALL
  SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR), n_name FROM nation
  UNION ALL
  SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'N' || CAST(s_nationkey AS VARCHAR), s_name FROM supplier"""

# CTEs that others build on.
_DEPS = {"fx_fact_sales": ["fx_nation"], "fx_dim_customer": ["fx_nation"]}


def with_fixtures(body: str) -> str:
    """Prefix ``body`` with the fixture CTEs it references (in dependency
    order).  ``body`` may itself start with further CTEs written as
    ``name AS (...)`` pieces joined by a leading comma-free ``WITH`` list."""
    used: list[str] = []

    def need(name: str) -> None:
        for d in _DEPS.get(name, []):
            need(d)
        if name not in used:
            used.append(name)

    for name in FIXTURES:
        if re.search(rf"\b{name}\b", body):
            need(name)
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]}\n)" for n in used)
    body = body.strip()
    if not ctes:
        return body
    head = body.upper()
    if head.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if head.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# Oracle-side U1, written from the JavaScript semantics: trim (JS white
# space), upper-case, look up; unknown -> trimmed upper text.
_JS_WS = r"[\t\n\x0B\f\r \x{00A0}\x{FEFF}\x{2028}\x{2029}\p{Zs}]"


def norm_country_sql(expr: str) -> str:
    from .functions.country import COUNTRY_SPELLINGS
    t = f"upper(regexp_replace({expr}, '^{_JS_WS}+|{_JS_WS}+$', '', 'g'))"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRY_SPELLINGS.items())
    return f"(CASE {t} {whens} ELSE {t} END)"


def date_lit(d) -> str:
    return f"DATE '{d.isoformat()}'"


def days_back(d, n: int) -> str:
    return f"CAST({date_lit(d)} - INTERVAL {n} DAY AS DATE)"


def hu_div(num: str, den: str, scale: int, num_scale: int = 0, out: str | None = None) -> str:
    """Oracle HALF_UP(num / den) to ``scale`` digits in integer arithmetic.
    ``num`` may be a DECIMAL with ``num_scale`` digits; ``den`` an integer."""
    n = f"CAST(round(({num}) * {10 ** num_scale}) AS HUGEINT)" if num_scale else f"CAST(({num}) AS HUGEINT)"
    d = f"(CAST(({den}) AS HUGEINT) * {10 ** num_scale})"
    q = f"((2 * abs({n}) * {10 ** scale} + {d}) // (2 * {d}))"
    val = f"CAST(sign({n}) * {q} AS DECIMAL(38,0)) * {'0.' + '0' * (scale - 1) + '1' if scale else '1'}"
    res = f"CASE WHEN ({den}) = 0 THEN NULL ELSE {val} END"
    return f"CAST({res} AS {out})" if out else res


FIXTURES["fx_offers"] = """
  SELECT l_partkey AS product_sk, l_suppkey AS supplier_sk,
         'SUP' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS supplier_sku,
         CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) * CAST(40 + l_suppkey % 20 AS DECIMAL(4,0)) * 0.01
              AS DECIMAL(12,4)) AS unit_cost,
         1 + (l_partkey + l_suppkey) % 14 AS lead_time_days,
         10 * (1 + l_suppkey % 5) AS moq
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x JOIN part p ON x.l_partkey = p.p_partkey"""


FIXTURES["fx_events_k"] = f"SELECT *, {K} AS k FROM events"

FIXTURES["fx_address"] = f"""
  SELECT user_id AS customer_sk, 'Street ' || CAST(k % 2 AS VARCHAR) AS address_line1,
         'City' || CAST(k % 3 AS VARCHAR) AS address_city, 'R' || CAST(user_id % 4 AS VARCHAR) AS address_region,
         {_pick('user_id % 3', ['US', 'GB', 'DE'])} AS address_country,
         lpad(CAST(user_id % 1000 AS VARCHAR), 5, '0') AS address_postal, ts
  FROM fx_events_k"""

FIXTURES["fx_inventory_feed"] = """
  SELECT 'WH' || CAST(user_id % 7 AS VARCHAR) AS warehouse_id, 'SKU' || CAST(k % 20 AS VARCHAR) AS sku,
         CAST(floor(value) AS BIGINT) AS on_hand, k % 10 AS allocated, (epoch_us(ts) // 1000) AS last_updated_ts, ts
  FROM fx_events_k"""

FIXTURES["fx_price_feed"] = """
  SELECT 'SKU' || CAST(k % 20 AS VARCHAR) AS sku, 'ST' || CAST(user_id % 10 AS VARCHAR) AS store_id,
         CAST(value AS DECIMAL(10,2)) AS price,
         CAST(CAST(value AS DECIMAL(10,2)) * CAST(1.25 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS list_price,
         CAST(CAST(value AS DECIMAL(10,2)) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(10,2)) AS cost,
         (epoch_us(ts) // 1000) AS updated_ts, 'rules' AS pricing_engine, ts
  FROM fx_events_k WHERE event_type IN ('purchase', 'view')"""

FIXTURES["fx_promo_feed"] = """
  SELECT CAST(user_id AS VARCHAR) AS customer_id, 'P' || CAST(k % 3 AS VARCHAR) AS promo_id,
         event_type <> 'error' AS eligible, event_type AS eligibility_reason,
         (epoch_us(ts) // 1000) AS valid_from_ts, (epoch_us(ts + INTERVAL 7 DAY) // 1000) AS valid_to_ts,
         event_type = 'purchase' AS redeemed, ts
  FROM fx_events_k"""

FIXTURES["fx_adjustments"] = f"""
  SELECT event_id AS adjustment_id, user_id % 7 AS warehouse_sk, 'SKU' || CAST(k % 20 AS VARCHAR) AS sku,
         k - 50 AS quantity_delta, {_pick('k % 4', td.ADJUST_REASONS)} AS reason_code,
         CAST(NULL AS VARCHAR) AS notes, 'EMP' || CAST(user_id % 13 AS VARCHAR) AS adjusted_by,
         ts AS adjusted_at,
         CASE WHEN k % 10 = 0 THEN NULL ELSE 'EMP' || CAST((user_id + k) % 13 AS VARCHAR) END AS approved_by,
         CASE WHEN k % 10 = 0 THEN NULL ELSE ts + to_minutes(CAST(k AS BIGINT)) END AS approved_at
  FROM fx_events_k WHERE event_type IN ('error', 'signup', 'view')"""

for _n in ("fx_address", "fx_inventory_feed", "fx_price_feed", "fx_promo_feed", "fx_adjustments"):
    _DEPS[_n] = ["fx_events_k"]


FIXTURES["fx_pos"] = f"""
  SELECT o_orderkey AS txn_id, 'ST' || CAST(o_custkey % 10 AS VARCHAR) AS store_id,
         CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS invoice_no,
         o_orderdate AS txn_ts, o_orderkey % 7 + 1 AS line_count,
         CAST(o_totalprice AS DECIMAL(14,2)) AS gross_amount,
         CAST(CAST(o_totalprice AS DECIMAL(14,2)) * CAST(o_orderkey % 5 AS DECIMAL(2,0)) * CAST(0.01 AS DECIMAL(3,2))
              AS DECIMAL(14,2)) AS discount_amount,
         CAST(CAST(o_totalprice AS DECIMAL(14,2)) * CAST(0.08 AS DECIMAL(3,2)) AS DECIMAL(14,2)) AS tax_amount,
         {_pick('o_orderkey % 3', td.TENDERS)} AS tender_type,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey % 17 = 0 END AS void_flag
  FROM orders"""

FIXTURES["fx_catalog"] = """
  SELECT 'SKU' || CAST(p_partkey AS VARCHAR) AS sku, 'SUP' || CAST(p_partkey % 50 AS VARCHAR) AS supplier_id,
         lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS upc,
         CASE WHEN v = 1 THEN '  ' || p_name || ' ' ELSE upper(p_name) END AS name,
         CASE WHEN v = 1 THEN lower(p_type) ELSE p_type END AS category, p_brand AS subcategory,
         CASE WHEN v = 1 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END AS color,
         ' ' || CAST(p_size AS VARCHAR) AS size,
         CASE WHEN v = 1 THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(1.05 AS DECIMAL(3,2)) AS DECIMAL(10,2))
              ELSE CAST(p_retailprice AS DECIMAL(10,2)) END AS msrp,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(10,2)) AS cost,
         DATE '1995-01-01' + CAST(p_partkey % 4000 AS INTEGER) AS available_from,
         CASE WHEN p_partkey % 9 = 0 THEN DATE '2000-01-01' + CAST(p_partkey % 900 AS INTEGER) END AS discontinued_at,
         CASE WHEN v = 1 THEN '20010201' ELSE '20010101' END AS feed_date
  FROM part, (VALUES (0), (1)) t(v)"""

FIXTURES["fx_tracking"] = f"""
  SELECT tracking_no,
         CASE WHEN warehouse_sk % 2 = 0 THEN lower(carrier) ELSE carrier END AS carrier,
         shipped_ts AS shipped_at, delivered_ts AS delivered_at,
         CASE WHEN delivered_ts IS NULL THEN 'in_transit' ELSE 'delivered' END AS status,
         'City' || CAST(warehouse_sk AS VARCHAR) || ', R' || CAST(warehouse_sk % 3 AS VARCHAR) || ' ,'
           || {_pick('warehouse_sk % 3', ['US', 'GB', 'DE'])} AS last_location,
         strftime(shipped_ts, '%Y%m%d') AS date_ts
  FROM fx_shipments"""

FIXTURES["fx_loyalty_raw"] = """
  SELECT CASE WHEN k % 17 = 0 THEN 'not-a-date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_ts_str,
         CAST(user_id AS VARCHAR) AS member_id,
         CASE WHEN event_type = 'click' THEN 'REDEEM' ELSE 'EARN' END AS event_type,
         CASE WHEN k % 13 = 0 THEN 'N/A' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS points,
         'ST' || CAST(user_id % 10 AS VARCHAR) AS store_id, CAST(event_id AS VARCHAR) AS tx_id,
         CASE WHEN k % 11 = 0 THEN 'garbage' ELSE 'k=' || CAST(k AS VARCHAR) || ';src=app' END AS meta_raw,
         strftime(ts, '%Y%m%d') AS date_ts
  FROM fx_events_k WHERE event_type IN ('click', 'purchase')"""

FIXTURES["fx_picks"] = """
  SELECT 'WH' || CAST(l_suppkey % 7 AS VARCHAR) AS warehouse_id, CAST(l_quantity AS BIGINT) AS quantity,
         l_shipdate + to_hours(CAST(l_suppkey % 24 AS BIGINT)) AS picked_at,
         CAST(20000 + (l_partkey % 97) * 1000 AS BIGINT) AS duration_ms
  FROM lineitem"""

FIXTURES["fx_movements"] = """
  SELECT 'WH' || CAST(l_suppkey % 7 AS VARCHAR) AS warehouse_id, 'SKU' || CAST(l_partkey AS VARCHAR) AS sku,
         CASE WHEN l_linestatus = 'O' THEN 'IN' ELSE 'OUT' END AS movement_type,
         CAST(l_quantity AS BIGINT) AS quantity,
         l_shipdate + to_hours(CAST(l_partkey % 24 AS BIGINT)) AS movement_ts
  FROM lineitem"""

FIXTURES["fx_costed_movements"] = f"""
  SELECT movement_id, sku, warehouse_id, kind AS movement_type,
         CASE WHEN kind = 'ADJUST' AND l_orderkey % 2 = 1 THEN -qty ELSE qty END AS quantity, unit_cost, movement_ts
  FROM (SELECT l_orderkey * 8 + l_linenumber AS movement_id, 'SKU' || CAST(l_partkey AS VARCHAR) AS sku,
               'WH' || CAST(l_suppkey % 7 AS VARCHAR) AS warehouse_id, l_orderkey, CAST(l_quantity AS BIGINT) AS qty,
               {_pick(f'(l_orderkey + l_linenumber) % {len(td.MOVEMENT_TYPES)}', td.MOVEMENT_TYPES)} AS kind,
               CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(12,4)) AS unit_cost,
               l_shipdate + to_hours(CAST(l_partkey % 24 AS BIGINT)) AS movement_ts
        FROM lineitem) x"""

FIXTURES["fx_addresses"] = f"""
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
         'Street ' || CAST(c_custkey % 97 AS VARCHAR) AS addr_line1,
         'City' || CAST(c_custkey % 50 AS VARCHAR) AS addr_city,
         'R' || CAST(c_custkey % 4 AS VARCHAR) AS addr_region,
         {_pick('c_nationkey % 3', ['US', 'GB', 'DE'])} AS addr_country,
         lpad(CAST(c_custkey % 500 AS VARCHAR), 5, '0') AS addr_postal,
         c_custkey, c_name, c_mktsegment
  FROM customer"""

FIXTURES["fx_geo"] = """
  SELECT DISTINCT addr_country AS country_iso2, CAST(NULL AS VARCHAR) AS city, addr_postal AS postal_code,
         CAST(CAST(addr_postal AS INTEGER) % 180 - 90 AS DOUBLE) AS latitude,
         CAST(CAST(addr_postal AS INTEGER) % 360 - 180 AS DOUBLE) AS longitude
  FROM fx_addresses WHERE CAST(addr_postal AS INTEGER) % 4 <> 0
  UNION ALL
  SELECT DISTINCT addr_country, addr_city, CAST(NULL AS VARCHAR),
         CAST(CAST(substring(addr_city, 5, 3) AS INTEGER) - 45 AS DOUBLE),
         CAST(CAST(substring(addr_city, 5, 3) AS INTEGER) * 3 AS DOUBLE)
  FROM fx_addresses WHERE CAST(substring(addr_city, 5, 3) AS INTEGER) % 5 <> 0"""

FIXTURES["fx_signups"] = """
  SELECT customer_id,
         ' ' || c_name || CASE WHEN v = 1 THEN '@New.Example.COM ' ELSE '@Example.COM' END AS email,
         '(555) ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
         'Pat' AS first_name, c_name AS last_name,
         addr_line1, addr_city, addr_region, addr_country, addr_postal,
         strftime(DATE '1998-01-01' + CAST(c_custkey % 700 + v * 400 AS INTEGER), '%Y%m%d') AS signup_date
  FROM fx_addresses, (VALUES (0), (1)) t(v)
  WHERE v = 0 OR c_custkey % 5 = 0"""

_DEPS["fx_tracking"] = ["fx_shipments"]
_DEPS["fx_loyalty_raw"] = ["fx_events_k"]
_DEPS["fx_geo"] = ["fx_addresses"]
_DEPS["fx_signups"] = ["fx_addresses"]


FIXTURES["fx_sales_retail"] = """
  SELECT invoice_no, 'SKU' || lpad(CAST(product_sk AS VARCHAR), 7, '0') AS stock_code, quantity,
         CASE WHEN CAST(invoice_no AS BIGINT) % 2 = 0 THEN strftime(invoice_ts, '%Y-%m-%d %H:%M:%S')
              ELSE strftime(invoice_ts, '%m/%d/%Y %H:%M') END AS invoice_date,
         unit_price, CAST(customer_sk AS VARCHAR) AS customer_id, country
  FROM fx_fact_sales"""

FIXTURES["fx_invoice_lines"] = """
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS invoice_no, l_orderkey, l_suppkey,
         'SKU' || CAST(l_partkey AS VARCHAR) AS sku, CAST(l_quantity AS BIGINT) AS qty,
         CAST(CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
                   // (2 * CAST(l_quantity AS BIGINT)) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(10,2)) AS unit_price,
         MIN(l_shipdate) OVER (PARTITION BY l_orderkey, l_suppkey) AS d
  FROM lineitem"""

FIXTURES["fx_clicks"] = """
  SELECT 'CMP' || CAST(k % 5 AS VARCHAR) AS campaign_id,
         CAST(user_id AS VARCHAR) || '-' || CAST(k % 5 AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS send_id,
         CAST(user_id AS VARCHAR) AS recipient, ts AS clicked_at, '/c/' || CAST(k AS VARCHAR) AS click_url
  FROM fx_events_k WHERE event_type = 'click'"""

_DEPS["fx_sales_retail"] = ["fx_fact_sales"]
_DEPS["fx_clicks"] = ["fx_events_k"]
