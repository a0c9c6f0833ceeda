"""Hand-made edge rows for the views (FIXTURES.md §4)."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import rows
from tillpoint.functions.country import normalize_country
from tillpoint.plans import views as v

SALES = ("invoice_no string, customer_sk bigint, product_sk bigint, quantity bigint, "
         "unit_price decimal(10,2), line_total decimal(14,2), country string, "
         "invoice_ts timestamp_ntz, sale_date date, store_sk bigint")
AS_OF = dt.date(2024, 6, 30)


def sale(inv, cust, prod, qty, total, country, day, store=1, ts=None):
    ts = ts or dt.datetime.combine(day, dt.time(12))
    return (inv, cust, prod, qty, D("1.00"), D(total), country, ts, day, store)


def test_v1_null_invoices_give_zero_aov(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([sale(None, 1, 1, 2, "10.00", "DE", d), sale(None, 2, 1, 3, "5.00", "DE", d),
                                sale("A", 1, 1, 1, "4.00", "FR", d), sale("A", 1, 2, 1, "6.00", "FR", d),
                                sale("B", 2, 2, 2, "5.00", "FR", d)], SALES)
    out = {r.country: r for r in v.daily_sales_by_country(df).collect()}
    assert out["DE"].orders == 0 and out["DE"].aov == 0.0 and out["DE"].basket_size == 0.0
    assert out["DE"].revenue == D("15.00") and out["DE"].units == 5
    assert out["FR"].orders == 2 and out["FR"].aov == 7.5 and out["FR"].basket_size == 2.0
    assert out["FR"].active_customers == 2


def test_v2_year_crossing_week_and_lag(spark):
    from tillpoint.sources.testdata import dim_date
    cal = dim_date(spark, dt.date(2018, 1, 1), dt.date(2021, 12, 31))
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=7 * i) for i in range(60)]
    days += [dt.date(2019, 12, 31), dt.date(2020, 1, 1)]  # same week, two years
    df = spark.createDataFrame([sale(str(i), 1, 1, 1, "1.00", "X", d) for i, d in enumerate(days)], SALES)
    out = v.weekly_running_totals(df, cal).orderBy("d_week_seq", "d_year").collect()
    crossing = [r for r in out if (r.d_year, r.wk_units) in ((2019, 1), (2020, 1))]
    seqs = {r.d_week_seq for r in out if r.d_year in (2019, 2020)}
    assert len(out) == 62 and len(seqs) <= 60
    assert out[52].same_week_last_year == out[0].wk_revenue  # 52 rows back
    assert out[0].same_week_last_year is None and out[0].yoy_delta == out[0].wk_revenue
    assert abs(out[20].rolling_13wk_avg - 1.0) < 1e-9
    assert crossing


def test_v3_rfm_boundaries_and_never(spark):
    cust = spark.createDataFrame([(i, str(i), "DE") for i in range(1, 9)],
                                 "customer_sk bigint, customer_id string, country string")
    lags = {1: 30, 2: 31, 3: 90, 4: 91, 5: 365, 6: 366, 7: 0}
    df = spark.createDataFrame([sale(f"I{c}", c, 1, 1, "2.50", "DE", AS_OF - dt.timedelta(days=n))
                                for c, n in lags.items()], SALES)
    out = {r.customer_sk: r for r in v.customer_lifetime_value(cust, df, AS_OF).collect()}
    assert [out[c].rfm_bucket for c in range(1, 9)] == [
        "active", "warm", "warm", "cold", "cold", "churned", "active", "never"]
    assert out[8].orders == 0 and out[8].lifetime_revenue is None and out[8].recency_days is None
    assert out[2].recency_days == 31


def test_v4_ties_rank_gaps_and_dense(spark):
    prod = spark.createDataFrame([(i, f"S{i}", f"d{i}") for i in range(1, 6)],
                                 "product_sk bigint, stock_code string, description string")
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([sale("a", 1, 1, 1, "10.00", "DE", d), sale("b", 1, 2, 1, "10.00", "DE", d),
                                sale("c", 1, 3, 1, "5.00", "DE", d), sale("d", 1, 4, 1, "7.00", "FR", d),
                                sale("e", 1, 5, 1, "5.00", None, d)], SALES)
    out = {(r.product_sk, r.country): (r.country_rank, r.global_rank)
           for r in v.product_performance(prod, df, n_buckets=3).collect()}
    assert out[(1, "DE")] == (1, 1) and out[(2, "DE")] == (1, 1) and out[(3, "DE")] == (3, 3)
    assert out[(4, "FR")] == (1, 2) and out[(5, None)] == (1, 3)


def test_v4_matches_plain_window_on_many_ties(spark):
    import random
    from pyspark.sql import Window
    from tillpoint.operators.ranking import bucketed_rank
    random.seed(7)
    data = [(random.choice(["a", "b", "c", None]), random.choice([None, 1, 2, 2, 3, 5, 8, 8, 8, 13]))
            for _ in range(400)]
    df = spark.createDataFrame(data, "g string, v int")
    got = bucketed_rank(df, ["g"], "v", "r", "rank", n_buckets=5)
    got = bucketed_rank(got, [], "v", "dr", "dense_rank", n_buckets=4)
    exp = df.select("g", "v", F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc())).alias("r"),
                    F.dense_rank().over(Window.orderBy(F.col("v").desc())).alias("dr"))
    assert rows(got, "g", "v", "r", "dr") == rows(exp, "g", "v", "r", "dr")


def test_v5_month_boundaries_and_null_customer(spark):
    df = spark.createDataFrame([sale("a", 1, 1, 1, "1.00", "X", dt.date(2024, 1, 31)),
                                sale("b", 1, 1, 1, "1.00", "X", dt.date(2024, 2, 1)),
                                sale("c", None, 1, 1, "1.00", "X", dt.date(2024, 1, 5))], SALES)
    assert rows(v.cohort_retention(df)) == [("2024-01", 0, 1), ("2024-01", 1, 1)]


def test_v6_inclusive_bounds_unknown_user_and_shared_order(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    ev = spark.createDataFrame(
        [("1", t0, ("ip", "US", "s", "ref1")), ("1", t0 + dt.timedelta(hours=2), ("ip", "US", "s", None)),
         ("9", t0, ("ip", "US", "s", "ref9"))],
        "user_id string, event_ts timestamp_ntz, context struct<ip:string,country:string,session_id:string,referrer:string>")
    cust = spark.createDataFrame([(101, "1")], "customer_sk bigint, customer_id string")
    s = [sale("at_start", 101, 1, 1, "1.00", "X", t0.date(), ts=t0),
         sale("at_end", 101, 1, 1, "2.00", "X", (t0 + dt.timedelta(days=1)).date(), ts=t0 + dt.timedelta(days=1)),
         sale("too_late", 101, 1, 1, "3.00", "X", t0.date(),
              ts=t0 + dt.timedelta(days=1, hours=2, microseconds=1))]
    out = v.session_to_order(ev, cust, spark.createDataFrame(s, SALES))
    got = rows(out, "user_id", "session_ts", "invoice_no")
    assert got == sorted([
        ("1", t0, "at_start"), ("1", t0, "at_end"),
        ("1", t0 + dt.timedelta(hours=2), "at_end"),
        ("9", t0, None)], key=lambda t: tuple((x is not None, x) for x in t))


def test_v7_member_without_store(spark):
    le = spark.createDataFrame(
        [(1, "m1", "REDEEM", 10, 1, AS_OF), (2, "m2", "REDEEM", 5, None, AS_OF),
         (3, "m1", "EARN", 99, 1, AS_OF), (4, "m3", "REDEEM", 7, 1, AS_OF - dt.timedelta(days=31))],
        "event_id bigint, member_id string, event_type string, points bigint, store_sk bigint, event_date date")
    stores = spark.createDataFrame([(1, "EU")], "store_sk bigint, region string")
    out = {r.region: r for r in v.active_member_panel(le, stores, AS_OF).collect()}
    assert out["EU"].exact_active_members == 1 and out["EU"].total_points_redeemed == 10
    assert out[None].exact_active_members == 1 and out[None].approx_active_members == 1


def test_v8_null_region_leaf_vs_subtotal(spark):
    d = AS_OF - dt.timedelta(days=1)
    df = spark.createDataFrame([sale("a", 1, 1, 1, "1.00", "X", d, store=1),
                                sale("b", 1, 1, 1, "2.00", "X", d, store=2),
                                sale("c", 1, 1, 1, "4.00", "X", d - dt.timedelta(days=30), store=1)], SALES)
    stores = spark.createDataFrame([(1, "EU"), (2, None)], "store_sk bigint, region string")
    out = rows(v.sales_rollup_by_region(df, stores, AS_OF), "region", "store_sk", "total_revenue",
               "line_count", "grouping_level")
    assert out == sorted([(None, None, D("3.00"), 2, 3), (None, None, D("2.00"), 1, 1),
                          (None, 2, D("2.00"), 1, 0), ("EU", None, D("1.00"), 1, 1), ("EU", 1, D("1.00"), 1, 0)],
                         key=lambda t: tuple((x is not None, x) for x in t))
    leaves = [r for r in out if r[4] == 0]
    assert sum(r[2] for r in leaves) == D("3.00")


def test_v9_roots_orphans_depth_cut_and_cycle(spark):
    nodes = [("r1", None, "Root1"), ("r2", "", "Root2"), ("o", "missing", "Orphan"),
             ("x", "y", "X"), ("y", "x", "Y")]
    chain = [("c0", "r1", "C0")] + [(f"c{i}", f"c{i-1}", f"C{i}") for i in range(1, 10)]
    df = spark.createDataFrame(nodes + chain, "category_id string, parent_id string, name string")
    out = {r.category_id: r for r in v.category_hierarchy(df).collect()}
    assert set(out) == {"r1", "r2"} | {f"c{i}" for i in range(8)}
    assert out["c7"].depth == 8 and out["c7"].path.startswith("Root1 > C0 > C1")
    assert max(r.depth for r in out.values()) == 8


def test_u1_normalisation_cases(spark):
    vals = [None, "", " usa ", "\tgermany ", "uk", "Atlantis ", "us", "japan"]
    df = spark.createDataFrame([(x,) for x in vals], "c string")
    got = [r[0] for r in df.select(normalize_country(F.col("c"))).collect()]
    assert got == [None, "", "US", "DE", "GB", "ATLANTIS", "US", "JP"]


def test_v10_country_match_required(spark):
    d = AS_OF - dt.timedelta(days=3)
    df = spark.createDataFrame([sale("a", 1, 1, 1, "1.00", "Germany", d), sale("b", 1, 2, 1, "2.00", "DE", d),
                                sale("c", 2, 1, 1, "5.00", None, d), sale("d", 3, 1, 1, "7.00", "France", d)], SALES)
    cust = spark.createDataFrame([(1, " deutschland"), (2, None), (3, "DE")], "customer_sk bigint, country string")
    out = rows(v.panel_continuity(df, cust, AS_OF))
    assert out == [(1, 1, 2, D("3.00"))]


def test_v11_sla_edges(spark):
    t = dt.datetime(2024, 6, 20, 8)
    df = spark.createDataFrame(
        [("c", t, t + dt.timedelta(hours=48)), ("c", t, t + dt.timedelta(hours=48, seconds=1)), ("c", t, None)],
        "carrier string, shipped_ts timestamp_ntz, delivered_ts timestamp_ntz")
    r = v.otd_by_carrier(df, AS_OF).collect()[0]
    assert r.shipments == 3 and abs(r.otd_rate - 1 / 3) < 1e-6
    assert abs(r.avg_transit_hours - (48 + 48 + 1 / 3600) / 2) < 1e-6


def test_v13_string_date_and_v14_three_valued(spark):
    sig = spark.createDataFrame([("a", "20240628"), ("b", "20240629"), ("c", "20240630")],
                                "customer_id string, signal_date string")
    assert [r.customer_id for r in v.fraud_recent(sig, AS_OF).orderBy("customer_id").collect()] == ["b", "c"]
    rma = spark.createDataFrame(
        [(f"r{i}", "c", "i", "s", 1, dt.datetime(2024, 6, 1, 23, 59), ap) for i, ap in enumerate([None, False, True])],
        "rma_id string, customer_id string, invoice_no string, stock_code string, quantity bigint, "
        "requested_at timestamp_ntz, approved boolean")
    out = v.returns_pending(rma, AS_OF).orderBy("rma_id").collect()
    assert [r.rma_id for r in out] == ["r0", "r1"] and out[0].days_pending == 29
