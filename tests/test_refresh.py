"""Late arrivals: partition-wise refresh equals a full build."""

import datetime as dt
import glob
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from tillpoint import registry
from tillpoint.plans.refresh import INGEST, refresh, touched_days

D0 = dt.date(2024, 5, 1)
SCHEMA = f"k string, day date, v long, {INGEST} date"


def day(n):
    return D0 + dt.timedelta(days=n)


def build(df):
    return df.groupBy("k", F.col("day").alias("out_day")).agg(F.sum("v").alias("v"))


def with_yesterday(df):
    """Day totals with the total of the day before."""
    t = df.groupBy("day").agg(F.sum("v").alias("v"))
    y = t.select(F.date_add("day", 1).alias("day"), F.col("v").alias("before"))
    return t.join(y, "day", "left").select(F.col("day").alias("out_day"), "v", "before")


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/out_day=*/*.parquet")}


def test_only_touched_days_are_written(spark):
    out = tempfile.mkdtemp(prefix="tillpoint-refresh-")
    first = [("a", day(n), n, day(20)) for n in range(10)] + [("b", day(n), 1, day(20)) for n in range(0, 10, 3)]
    landed = spark.createDataFrame(first, SCHEMA)
    r = refresh(landed, None, F.col("day"), build, out, "out_day")
    assert r.upto == day(20) and r.days == [day(n) for n in range(10)] and not r.emptied
    before = files(out)
    late = [("a", day(3), 100, day(21)), ("c", day(7), 5, day(21)), ("c", day(15), 5, day(21)), ("n", None, 1, day(21))]
    landed = spark.createDataFrame(first + late, SCHEMA)
    assert touched_days(landed, F.col("day"), day(20)) == ([day(3), day(7), day(15)], day(21))
    r = refresh(landed, day(20), F.col("day"), build, out, "out_day")
    assert r.days == [day(3), day(7), day(15)] and r.upto == day(21)
    after = files(out)
    same = {f for f in before if not any(f"out_day={d}" in f for d in r.days)}
    assert {f: after[f] for f in same} == {f: before[f] for f in same} and len(same) == 8
    assert rows(spark.read.parquet(out), "k", "out_day", "v") == rows(build(landed.filter("day IS NOT NULL")), "k", "out_day", "v")
    assert refresh(landed, day(21), F.col("day"), build, out, "out_day").days == [] and files(out) == after


def test_days_that_reach_into_others(spark):
    out = tempfile.mkdtemp(prefix="tillpoint-refresh-")
    first = [("a", day(n), n + 1, day(20)) for n in (0, 1, 2, 5, 6)]
    late = [("a", day(1), 7, day(21)), ("a", day(6), 7, day(22))]
    since = None
    for have in (first, first + late[:1], first + late):
        landed = spark.createDataFrame(have, SCHEMA)
        r = refresh(landed, since, F.col("day"), with_yesterday, out, "out_day", reach=(1, 0))
        since = r.upto
        assert rows(spark.read.parquet(out), "out_day", "v", "before") == rows(with_yesterday(landed), "out_day", "v", "before")
    assert r.days == [day(6), day(7)] and r.emptied == [day(7)]


def test_a_day_that_lost_its_rows_loses_its_partition(spark):
    out = tempfile.mkdtemp(prefix="tillpoint-refresh-")
    rows_ = [("a", day(0), 1, day(20)), ("a", day(1), 1, day(20))]
    refresh(spark.createDataFrame(rows_, SCHEMA), None, F.col("day"), build, out, "out_day")
    landed = spark.createDataFrame([*rows_, ("a", day(1), -1, day(21))], SCHEMA)
    r = refresh(landed, day(20), F.col("day"), lambda d: build(d).filter("v <> 0"), out, "out_day")
    assert r.emptied == [day(1)] and rows(spark.read.parquet(out), "out_day") == [(day(0),)]


def test_nothing_landed(spark):
    out = tempfile.mkdtemp(prefix="tillpoint-refresh-")
    r = refresh(spark.createDataFrame([], SCHEMA), None, F.col("day"), build, out, "out_day")
    assert (r.days, r.emptied, r.upto) == ([], [], None)


def test_landing_is_not_one_task_for_the_first_day(spark):
    """Nearly all shipments arrive on one day; they are written by as many
    tasks as read them."""
    sf = tempfile.mkdtemp(prefix="tillpoint-sf-")
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").filter(F.col("l_shipdate") > F.lit(dt.date(2001, 7, 1)))  # few days: quick
    lines.repartition(6).write.parquet(f"{sf}/lineitem.parquet")
    base = spark.sparkContext.getCheckpointDir()
    known = set(glob.glob(f"{base.removeprefix('file:')}/shipments_landed-*"))
    registry.queries()["P3_late_arrivals_refresh_otd"](spark, sf)
    landing, = set(glob.glob(f"{base.removeprefix('file:')}/shipments_landed-*")) - known
    days = sorted(glob.glob(f"{landing}/{INGEST}=*"))
    assert len(days) == 3 and len(glob.glob(f"{days[0]}/*.parquet")) > 1
