"""Registered query for F6 as a daily snapshot."""

from __future__ import annotations

import datetime as dt

from ..oracle_fixtures import date_lit
from ..registry import register
from ..sources import testdata as td
from . import inventory as inv

# The partitions that one monthly run writes.
FIRST, LAST = dt.date(1997, 6, 1), dt.date(1997, 6, 30)


def _sum_sql(part: int) -> str:
    terms = " ".join(f"WHEN '{t}' THEN {e[part]}" for t, e in inv.EFFECTS.items())
    return f"(CASE movement_type {terms} ELSE 0 END * quantity)"


# The oracle composes the steps of each key from the first one to every day's
# end anew (list_reduce over a growing list).
@register("F6b_inventory_daily_snapshot", f"""
WITH m AS (
  SELECT *, CAST(movement_ts AS DATE) AS day, {_sum_sql(0)} AS stock, {_sum_sql(1)} AS alloc, {_sum_sql(2)} AS way,
         SUM({_sum_sql(0)}) OVER w - {_sum_sql(0)} AS before
  FROM fx_costed_movements WINDOW w AS (PARTITION BY sku, warehouse_id ORDER BY movement_ts, movement_id ROWS UNBOUNDED PRECEDING)),
steps AS (
  SELECT sku, warehouse_id, movement_ts, movement_id, unit_cost,
         {{'keep': CASE WHEN before > 0 THEN before::DOUBLE / (before + stock)::DOUBLE ELSE 0.0::DOUBLE END,
          'add': CASE WHEN before > 0 THEN stock * unit_cost::DOUBLE / (before + stock)::DOUBLE ELSE unit_cost::DOUBLE END}} AS step
  FROM m WHERE stock > 0 AND unit_cost IS NOT NULL),
keys AS (
  SELECT sku, warehouse_id, list(step ORDER BY movement_ts, movement_id) AS steps,
         list(CAST(movement_ts AS DATE) ORDER BY movement_ts, movement_id) AS days, arg_min(unit_cost::DOUBLE, (movement_ts, movement_id)) AS first_cost
  FROM steps GROUP BY sku, warehouse_id),
days AS (
  SELECT sku, warehouse_id, day, SUM(stock) AS stock, SUM(alloc) AS alloc, SUM(way) AS way, MAX(movement_ts) AS last_ts
  FROM m GROUP BY sku, warehouse_id, day),
states AS (
  SELECT d.sku, d.warehouse_id, d.day, d.last_ts, SUM(stock) OVER w AS on_hand, SUM(alloc) OVER w AS allocated, SUM(way) OVER w AS in_transit,
         LEAD(d.day) OVER (PARTITION BY d.sku, d.warehouse_id ORDER BY d.day) AS next_day,
         list_reduce(list_prepend({{'keep': 1.0::DOUBLE, 'add': 0.0::DOUBLE}}, k.steps[1:len(list_filter(k.days, lambda x: x <= d.day))]),
                     lambda a, s: {{'keep': a.keep * s.keep, 'add': a.add * s.keep + s.add}}) AS total, k.first_cost
  FROM days d LEFT JOIN keys k USING (sku, warehouse_id)
  WINDOW w AS (PARTITION BY d.sku, d.warehouse_id ORDER BY d.day ROWS UNBOUNDED PRECEDING)),
grid AS (SELECT CAST(unnest(generate_series({date_lit(FIRST)}, {date_lit(LAST)}, INTERVAL 1 DAY)) AS DATE) AS snapshot_date)
SELECT sku, CAST(substring(warehouse_id, 3) AS BIGINT) AS warehouse_sk, CAST(on_hand AS BIGINT) AS on_hand_units,
       CAST(allocated AS BIGINT) AS allocated_units, CAST(in_transit AS BIGINT) AS in_transit_units,
       CAST(on_hand - allocated AS BIGINT) AS available_units,
       CAST(round(total.keep * first_cost + total.add + 1e-9, 4) AS DECIMAL(12,4)) AS avg_cost, last_ts AS last_movement_ts, snapshot_date
FROM states JOIN grid ON day <= snapshot_date AND (next_day IS NULL OR snapshot_date < next_day)""")
def q_f6b(spark, sf):
    return inv.inventory_daily_snapshot(td.costed_movements(spark, sf), FIRST, LAST)
