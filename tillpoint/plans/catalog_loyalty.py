"""Registered queries for C6 with expiry."""

from __future__ import annotations

import datetime as dt

from ..registry import register
from ..sources import testdata as td
from . import loyalty as ly
from . import state as st

AS_OF = dt.datetime(2024, 1, 25)
EXPIRY = 10
AS_OF_SQL = f"TIMESTAMP '{AS_OF.isoformat(sep=' ')}'"

# The interval of every lot and redemption by the closed form, then a plain
# range join of the two.
_LOTS_SQL = f"""
  WITH e AS (SELECT event_id, member_id, event_type, points, event_ts FROM fx_loyalty WHERE points > 0 AND event_ts <= {AS_OF_SQL}),
  line AS (
    SELECT member_id, event_id, event_type AS kind, event_ts AS moment, 1 AS rank, points FROM e
    UNION ALL SELECT member_id, event_id, 'LAPSE', event_ts + INTERVAL {EXPIRY} DAY, 0, points FROM e
    WHERE event_type = 'EARN' AND event_ts + INTERVAL {EXPIRY} DAY <= {AS_OF_SQL}),
  sums AS (
    SELECT *, SUM(CASE WHEN kind = 'EARN' THEN points ELSE 0 END) OVER w AS all_earned,
           SUM(CASE WHEN kind = 'REDEEM' THEN points ELSE 0 END) OVER w AS all_redeemed,
           SUM(CASE WHEN kind = 'LAPSE' THEN points ELSE 0 END) OVER w AS all_lapsed
    FROM line WINDOW w AS (PARTITION BY member_id ORDER BY moment, rank, event_id ROWS UNBOUNDED PRECEDING)),
  uses AS (
    SELECT member_id, points, all_redeemed + MAX(all_lapsed - all_redeemed + points) OVER (
             PARTITION BY member_id ORDER BY moment, rank, event_id ROWS UNBOUNDED PRECEDING) AS last
    FROM sums WHERE kind = 'REDEEM'),
  lots AS (SELECT member_id, event_id, moment, points, all_earned AS last FROM sums WHERE kind = 'EARN'),
  taken AS (
    SELECT l.event_id, SUM(LEAST(l.last, u.last) - GREATEST(l.last - l.points, u.last - u.points)) AS used
    FROM lots l JOIN uses u ON l.member_id = u.member_id AND u.last - u.points < l.last AND l.last - l.points < u.last
    GROUP BY l.event_id)
  SELECT event_id AS lot_id, member_id, moment AS earned_ts, moment + INTERVAL {EXPIRY} DAY AS expiry_ts, points AS points_earned,
         CAST(COALESCE(used, 0) AS BIGINT) AS points_redeemed,
         CAST(CASE WHEN moment + INTERVAL {EXPIRY} DAY <= {AS_OF_SQL} THEN points - COALESCE(used, 0) ELSE 0 END AS BIGINT) AS points_expired,
         CAST(CASE WHEN moment + INTERVAL {EXPIRY} DAY <= {AS_OF_SQL} THEN 0 ELSE points - COALESCE(used, 0) END AS BIGINT) AS points_remaining
  FROM lots LEFT JOIN taken USING (event_id)"""


@register("C6b_loyalty_lots", _LOTS_SQL)
def q_c6b(spark, sf):
    return ly.loyalty_lots(td.fact_loyalty_events(spark, sf), AS_OF, EXPIRY)


@register("C6c_loyalty_ledger_with_expiry", f"""
WITH lots AS ({_LOTS_SQL}),
entries AS (
  SELECT event_id AS entry_id, member_id, CASE WHEN event_type = 'EARN' THEN points ELSE -points END AS points_delta,
         event_ts, event_type, CAST(event_id AS VARCHAR) AS reference_id,
         CASE WHEN event_type = 'EARN' THEN event_ts + INTERVAL {EXPIRY} DAY END AS expiry_ts
  FROM fx_loyalty WHERE event_ts <= {AS_OF_SQL}
  UNION ALL
  SELECT -1 - lot_id, member_id, -points_expired, expiry_ts, 'EXPIRE', CAST(lot_id AS VARCHAR), NULL
  FROM lots WHERE points_expired > 0)
SELECT entry_id, member_id, points_delta,
       CAST(SUM(points_delta) OVER (PARTITION BY member_id ORDER BY event_ts, entry_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_balance,
       event_ts, event_type, reference_id, expiry_ts
FROM entries""")
def q_c6c(spark, sf):
    events = td.fact_loyalty_events(spark, sf)
    return ly.ledger_with_expiry(st.loyalty_points_ledger(events, EXPIRY), ly.loyalty_lots(events, AS_OF, EXPIRY), AS_OF)
