"""Plan assertions: the properties that matter at scale, read from the
physical plans."""

import datetime as dt
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
import __spark_entry__ as ent
from tillpoint.functions.country import normalize_country
from tillpoint.plans import views as v
from tillpoint.sources import sinks as P
from tillpoint.sources import testdata as td


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()  # physical plan text, as .explain() prints


def explain(df) -> str:
    import io
    from contextlib import redirect_stdout
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(ent.queries()))
def test_no_cartesian_and_no_python_rows(spark, key):
    text = explain(ent.queries()[key](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text, f"{key}: {bad}"


def test_u1_is_native(spark):
    df = spark.createDataFrame([(" uk ",)], "c string").select(normalize_country(F.col("c")))
    text = explain(df)
    assert "EvalPython" not in text and "regexp_replace" in text


def test_v8_v11_prune_partitions(spark):
    d1, d2 = tempfile.mkdtemp(), tempfile.mkdtemp()
    recent = dt.date(2001, 1, 1)  # fewer day folders keep the test quick
    P.write_partitioned(td.fact_shipments(spark, SF_SMALL).filter(F.col("_partition_date") >= recent), d1,
                        ["_partition_date"])
    P.write_partitioned(td.fact_sales(spark, SF_SMALL).filter(F.col("sale_date") >= recent), d2, ["sale_date"])
    t11 = explain(v.otd_by_carrier(spark.read.parquet(d1), td.SHIP_AS_OF))
    assert re.search(r"PartitionFilters: \[isnotnull\(_partition_date#\d+\), \(_partition_date#\d+ >= 2001-10-05\)", t11)
    t8 = explain(v.sales_rollup_by_region(spark.read.parquet(d2), td.dim_store(spark, SF_SMALL), td.SALES_AS_OF))
    assert re.search(r"PartitionFilters: \[isnotnull\(sale_date#\d+\), \(sale_date#\d+ >= 2001-07-25\)", t8)


def test_v6_interval_join_is_hash_keyed_by_day(spark):
    df = v.session_to_order(td.mobile_events(spark, SF_SMALL), td.dim_customer(spark, SF_SMALL),
                            td.app_sales(spark, SF_SMALL))
    text = explain(df)
    joins = [ln for ln in text.splitlines() if "Join LeftOuter" in ln]
    assert joins and "__day" in text and "Left keys [2]" in text


def test_v4_ranks_without_single_partition_over_rows(spark):
    df = v.product_performance(td.dim_product(spark, SF_SMALL), td.fact_sales(spark, SF_SMALL))
    text = explain(df)
    # windows over data rows are partitioned by the value bucket; the only
    # single-partition windows run over per-bucket counts (one row per bucket)
    windows = [ln for ln in text.splitlines() if ln.strip().startswith("Arguments:") and "rank(" in ln]
    assert windows and all("__rank_bucket" in ln for ln in windows)


def test_b1_feed_is_dealt_before_it_is_unpivoted(spark):
    """The unpivoted rows of one large file are not counted in one task."""
    text = plan(ent.queries()["B1_bridge_product_attribute"](spark, SF_SMALL))
    below = text.split("unpivot" if "unpivot" in text else "attribute_name")[-1]
    assert re.search(r"Exchange hashpartitioning\(sku#\d+, feed_date#\d+", below)


def test_a1_sets_with_the_largest_dimension_share_its_exchange(spark):
    text = plan(ent.queries()["A1_sales_cube"](spark, SF_SMALL))
    assert re.search(r"Exchange hashpartitioning\(product_sk#\d+L?, \d+\)", text)
    assert not re.search(r"Exchange hashpartitioning\((country|month_key)#\d+L?, product_sk#\d+L?, \d+\)", text)


def test_f6b_steps_stay_where_the_running_stock_put_them(spark):
    """Movements go through one exchange, openings through three, days through one."""
    text = plan(ent.queries()["F6b_inventory_daily_snapshot"](spark, SF_SMALL))
    assert len(re.findall(r"Exchange hashpartitioning\(", text)) <= 5
    assert not re.search(r"Exchange hashpartitioning\([^)]*hour", text) and "posexplode" not in text
