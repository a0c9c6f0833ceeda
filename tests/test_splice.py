"""SCD-2 with late snapshots: any order of arrival gives the one-shot history."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from tillpoint.operators.merge import scd2_from_changes, scd2_splice
from tillpoint.plans import state as st
from tillpoint.sources import testdata as td

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, a string, b int"
HISTORY = "k string, a string, b int, eff_from timestamp_ntz, eff_to timestamp_ntz, is_current boolean, change_reason string, version bigint"
COLS = ("k", "a", "b", "eff_from", "eff_to", "is_current", "change_reason", "version")


def at(h):
    return T0 + dt.timedelta(hours=h)


def run(spark, batches):
    history, seen = spark.createDataFrame([], HISTORY), spark.createDataFrame([], "k string, ts timestamp_ntz")
    for b in batches:
        history, seen = scd2_splice(history, seen, spark.createDataFrame(b, SCHEMA), ["k"], "ts", ["a", "b"])
    return history, seen


def one_shot(spark, snapshots):
    return scd2_from_changes(spark.createDataFrame(snapshots, SCHEMA), ["k"], "ts", ["a", "b"])


def test_a_late_change_splits_a_closed_version(spark):
    first = [("x", at(0), "A", 1), ("x", at(10), "A", 1), ("x", at(20), "B", 1)]
    history, _ = run(spark, [first, [("x", at(5), "L", 1)]])
    assert rows(history, "a", "eff_from", "eff_to", "change_reason", "version") == sorted([
        ("A", at(0), at(5), "new", 1), ("L", at(5), at(10), "changed", 2), ("A", at(10), at(20), "changed", 3), ("B", at(20), None, "changed", 4)],
        key=lambda t: tuple((x is not None, x) for x in t))


def test_late_rows_before_the_first_equal_ones_and_removed_starts(spark):
    cases = [
        ([("x", at(5), "A", 1)], [("x", at(1), "A", 1)]),  # the start moves forward
        ([("x", at(5), "A", 1)], [("x", at(1), "Z", None)]),  # a new first version
        ([("x", at(0), "A", 1), ("x", at(9), "B", 2)], [("x", at(4), "B", 2)]),  # the start of B moves
        ([("x", at(0), "A", 1), ("x", at(9), "A", 1)], [("x", at(4), "A", 1)]),  # nothing changes
        ([("x", at(0), None, None), ("y", at(0), "A", 1)], [("x", at(50), None, 3), ("x", at(40), None, None)]),
    ]
    for first, late in cases:
        got, seen = run(spark, [first, late, late, first])
        assert rows(got, *COLS) == rows(one_shot(spark, first + late), *COLS)
        assert seen.count() == len(first) + len(late)


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_arrival(spark, seed):
    rng = random.Random(seed)
    made = {(k, h): (k, at(h), rng.choice("AB"), rng.choice((1, None)))
            for k in ("hot", "hot2", None, "c") for h in rng.sample(range(24 * 9), 50 if k and k != "c" else 3)}
    snapshots = list(made.values())
    rng.shuffle(snapshots)
    cut = sorted(rng.sample(range(len(snapshots)), 2))
    batches = [snapshots[:cut[0]], snapshots[cut[0]:cut[1]], snapshots[cut[1]:] + snapshots[:5]]
    got, seen = run(spark, batches)
    assert rows(got, *COLS) == rows(one_shot(spark, snapshots), *COLS)
    assert seen.count() == len(snapshots)


def test_untouched_keys_pass_through(spark):
    first = [("x", at(0), "A", 1), ("y", at(0), "A", 1), ("y", at(3), "B", 1)]
    history, seen = run(spark, [first])
    marked = history.withColumn("change_reason", F.when(F.col("k") == "y", "kept").otherwise(F.col("change_reason")))
    after, _ = scd2_splice(marked, seen, spark.createDataFrame([("x", at(2), "C", 1)], SCHEMA), ["k"], "ts", ["a", "b"])
    assert {r.change_reason for r in after.filter("k = 'y'").collect()} == {"kept"} and after.filter("k = 'x'").count() == 2


def test_no_snapshots(spark):
    history, seen = run(spark, [[], []])
    assert history.count() == 0 and seen.count() == 0


def test_addresses_in_any_order(spark):
    snapshots = td.address_snapshots(spark, SF_SMALL)
    part = F.pmod(F.xxhash64("ts"), F.lit(2))
    got = st.customer_address_history_spliced([snapshots.filter(part == 1), snapshots.filter(part == 0)])
    assert rows(got) == rows(st.customer_address_history(snapshots))


def test_a_step_is_computed_once_and_a_replay_joins_nothing(spark):
    seen_rows = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen_rows.add(b.num_rows)
            yield b

    snapshots = [("x", at(h), "AB"[h % 2], h) for h in range(6)]
    batch, seen = spark.createDataFrame(snapshots, SCHEMA), spark.createDataFrame([], "k string, ts timestamp_ntz")
    counted = spark.createDataFrame([], HISTORY)
    history, seen = scd2_splice(counted, seen, batch, ["k"], "ts", ["a", "b"])
    before = rows(history, *COLS)
    watched = history.mapInArrow(look, history.schema)
    replayed, _ = scd2_splice(watched, seen, batch, ["k"], "ts", ["a", "b"])
    assert seen_rows.value == len(before) == 6
    assert "Join" not in replayed._jdf.queryExecution().executedPlan().toString() and rows(replayed, *COLS) == before
