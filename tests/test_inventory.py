"""F6 daily snapshot against a walk through each key's movements."""

import datetime as dt
import random
from collections import defaultdict
from fractions import Fraction

from conftest import rows
from tillpoint.plans import inventory as inv

D0 = dt.date(2024, 3, 1)
SCHEMA = "movement_id long, sku string, warehouse_id string, movement_type string, quantity long, unit_cost decimal(12,4), movement_ts timestamp_ntz"


def made_movements(n=1500):
    import decimal
    rng = random.Random(3)
    out = []
    for i in range(n):
        sku = rng.choice(["hot"] * 6 + ["a", "b"])
        kind = rng.choice([*inv.EFFECTS, "IN", "IN", "OUT", "OUT", "COUNT"])
        q = rng.randrange(1, 30) * (rng.choice((-1, 1)) if kind == "ADJUST" else 1)
        at = dt.datetime(2024, 3, 1) + dt.timedelta(hours=rng.randrange(24 * 40) // 3 * 3)
        out.append((i, sku, rng.choice(("WH1", "WH22")), kind, q, decimal.Decimal(rng.randrange(100, 9999)) / 100, at))
    out += [(5000, "out_only", "WH1", "OUT", 4, None, dt.datetime(2024, 3, 5)), (5001, None, "WH1", "IN", 4, None, dt.datetime(2024, 3, 5)),
            (5002, "no_time", "WH1", "IN", 4, None, None), (5003, "no_qty", "WH1", "IN", None, decimal.Decimal(2), dt.datetime(2024, 3, 6))]
    return out


def walked(movements, first, last):
    by = defaultdict(list)
    for i, sku, wh, kind, q, u, at in movements:
        if sku is not None and at is not None:
            by[sku, wh].append((at, i, kind, q or 0, u))
    for (sku, wh), of in by.items():
        of.sort(key=lambda x: x[:2])
        cost = next((Fraction(u) for _, _, k, q, u in of if inv.EFFECTS.get(k, (0,))[0] * q > 0 and u is not None), None)
        have, alloc, way, day = 0, 0, 0, of[0][0].date()
        last_ts, rest = None, list(of)
        while day <= last:
            while rest and rest[0][0].date() <= day:
                last_ts, _, kind, q, u = rest.pop(0)
                e = inv.EFFECTS.get(kind, (0, 0, 0))
                x = e[0] * q
                if x > 0 and u is not None:
                    cost = (have * cost + x * Fraction(u)) / (have + x) if have > 0 else Fraction(u)
                have, alloc, way = have + x, alloc + e[1] * q, way + e[2] * q
            if day >= first:
                yield (sku, int(wh[2:]), have, alloc, way, have - alloc, None if cost is None else float(cost), last_ts, day)
            day += dt.timedelta(days=1)


def test_daily_snapshot_equals_a_walk(spark):
    made = made_movements()
    df = spark.createDataFrame(made, SCHEMA)
    for first, last in ((D0, dt.date(2024, 4, 30)), (dt.date(2024, 3, 20), dt.date(2024, 3, 22)), (dt.date(2024, 6, 1), dt.date(2024, 6, 1))):
        got = {(r.sku, r.warehouse_sk, r.snapshot_date): r for r in inv.inventory_daily_snapshot(df, first, last).collect()}
        want = list(walked(made, first, last))
        assert len(got) == len(want) > 0
        for sku, wh, have, alloc, way, free, cost, last_ts, day in want:
            r = got[sku, wh, day]
            assert (r.on_hand_units, r.allocated_units, r.in_transit_units, r.available_units, r.last_movement_ts) == (have, alloc, way, free, last_ts)
            assert (r.avg_cost is None) == (cost is None)
            assert cost is None or abs(float(r.avg_cost) - cost) <= 0.00005000001


def test_snapshot_of_no_movements(spark):
    assert rows(inv.inventory_daily_snapshot(spark.createDataFrame([], SCHEMA), D0, D0)) == []
