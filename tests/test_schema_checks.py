"""Q2 and Q11: checks that look at schemas and plans, not at rows."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from conftest import SF_SMALL
from tillpoint import schemas
from tillpoint.plans import quality as q
from tillpoint.plans import views as v
from tillpoint.sources import testdata as td

CONFORM = {"fact_sales": td.fact_sales, "fact_shipments": td.fact_shipments, "mobile_events": td.mobile_events,
           "fraud_signals": td.fraud_signals, "omniture_logs": td.omniture_logs}


@pytest.mark.parametrize("name", sorted(CONFORM))
def test_q2_produced_tables_have_the_declared_columns(spark, name):
    found = q.check_schema(spark, name, schemas.schema(name), CONFORM[name](spark, SF_SMALL).schema).collect()
    assert found and all(r.check == "Q2_schema" for r in found)


def test_q11_views_resolve_over_the_declared_schemas(spark):
    a = dt.date(2024, 1, 31)
    inputs = {n: schemas.schema(n) for n in schemas.DDL}
    inputs["dim_date"] = T.DataType.fromDDL("d_date date, d_week_seq bigint, d_year bigint")
    builders = {
        "V1": (v.daily_sales_by_country, ["fact_sales"]),
        "V2": (v.weekly_running_totals, ["fact_sales", "dim_date"]),
        "V3": (v.customer_lifetime_value, ["dim_customer", "fact_sales", a]),
        "V4": (v.product_performance, ["dim_product", "fact_sales"]),
        "V5": (v.cohort_retention, ["fact_sales"]),
        "V6": (v.session_to_order, ["mobile_events", "dim_customer", "fact_sales"]),
        "V7": (v.active_member_panel, ["fact_loyalty_events", "dim_store", a]),
        "V8": (v.sales_rollup_by_region, ["fact_sales", "dim_store", a]),
        "V8_as_written": (lambda f, s, d: v.sales_rollup_by_region(f, s, d, fact_key="customer_sk"), ["fact_sales", "dim_store", a]),
        "V9": (v.category_hierarchy, ["dim_category"]),
        "V10": (v.panel_continuity, ["fact_sales", "dim_customer", a]),
        "V11": (v.otd_by_carrier, ["fact_shipments", a]),
        "V12": (v.omniture, ["omniture_logs"]),
        "V13": (v.fraud_recent, ["fraud_signals", a]),
        "V14": (v.returns_pending, ["return_authorizations", a]),
    }
    got = {r.object: r.passed for r in q.check_resolves(spark, builders, inputs).collect()}
    assert len(got) == len(builders)
    # the fact's declared schema has no store key: the default join of V8 is the one that cannot resolve
    assert {k for k, ok in got.items() if not ok} <= {"V8"}
