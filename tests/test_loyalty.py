"""C6 with expiry against a queue of lots per member."""

import collections
import datetime as dt
import random

from conftest import rows
from tillpoint.plans import loyalty as ly
from tillpoint.plans import state as st

T0 = dt.datetime(2024, 1, 1)
AS_OF = dt.datetime(2024, 2, 10)
SCHEMA = "event_id long, member_id string, event_type string, points long, event_ts timestamp_ntz, tx_id string"


def made_events(n=900):
    rng = random.Random(5)
    out = []
    for i in range(n):
        member = rng.choice(["hot"] * 8 + ["a", "b", "c"])
        kind = rng.choice(("EARN", "REDEEM"))
        at = T0 + dt.timedelta(hours=6 * rng.randrange(150))  # ties, and lapses at the instant of events
        out.append((i, member, kind, rng.choice((0, 1, 2, 5, 40, 300)), at, f"t{i}"))
    out += [(9000, None, "EARN", 5, T0, "x"), (9001, "never", "REDEEM", 7, T0, "x"), (9002, "late", "EARN", 5, dt.datetime(2025, 1, 1), "x")]
    return out


def queue_of_lots(events, days):
    """Points of each lot taken, by walking a member's events in order."""
    taken, matches = collections.Counter(), collections.Counter()
    by = collections.defaultdict(list)
    for i, member, kind, points, at, _ in events:
        if member is not None and points > 0 and at <= AS_OF:
            by[member].append((at, i, kind, points))
    for of in by.values():
        lots, owed = collections.deque(), collections.deque()
        for at, i, kind, points in sorted(of):
            while lots and lots[0][1] + dt.timedelta(days=days) <= at:
                lots.popleft()
            if kind == "EARN":
                lots.append([i, at, points])
            else:
                owed.append([i, points])
            while lots and owed:
                n = min(lots[0][2], owed[0][1])
                taken[lots[0][0]] += n
                matches[lots[0][0], owed[0][0]] += n
                lots[0][2] -= n
                owed[0][1] -= n
                if not owed[0][1]:
                    owed.popleft()
                if not lots[0][2]:
                    lots.popleft()
    return taken, matches


def test_lots_equal_a_queue(spark):
    events = made_events()
    df = spark.createDataFrame(events, SCHEMA)
    for days in (3, 10, 365):
        taken, matches = queue_of_lots(events, days)
        want = []
        for i, member, kind, points, at, _ in events:
            if member is not None and kind == "EARN" and points > 0 and at <= AS_OF:
                end, left = at + dt.timedelta(days=days), points - taken[i]
                want.append((i, member, at, end, points, taken[i], left if end <= AS_OF else 0, 0 if end <= AS_OF else left))
        assert rows(ly.loyalty_lots(df, AS_OF, days)) == sorted(want)
        for bucket in (7, 100_000):
            got = ly.point_matches(ly.point_intervals(df, AS_OF, days), bucket)
            assert rows(got, "lot_id", "redemption_id", "points") == sorted((a, b, n) for (a, b), n in matches.items())
        assert sum(taken.values()) > 0 and any(w[6] for w in want) == (days < 365)


def test_ledger_balances_with_expiry(spark):
    events = made_events()
    df = spark.createDataFrame(events, SCHEMA)
    lots = ly.loyalty_lots(df, AS_OF, 5)
    got = ly.ledger_with_expiry(st.loyalty_points_ledger(df, 5), lots, AS_OF).collect()
    balance = collections.Counter()
    for r in sorted((r for r in got if r.member_id is not None), key=lambda r: (r.event_ts, r.entry_id)):
        balance[r.member_id] += r.points_delta
        assert r.running_balance == balance[r.member_id]
    remaining = collections.Counter()
    for r in lots.collect():
        remaining[r.member_id] += r.points_remaining
    # what is left in lots is the balance, where nothing is owed
    assert all(balance[m] == remaining[m] or balance[m] < remaining[m] for m in remaining)
    assert balance["never"] == -7 and not remaining["never"]


def test_loyalty_of_no_events(spark):
    empty = spark.createDataFrame([], SCHEMA)
    lots = ly.loyalty_lots(empty, AS_OF)
    assert lots.count() == 0
    assert ly.ledger_with_expiry(st.loyalty_points_ledger(empty), lots, AS_OF).count() == 0
