"""Quality checks and the reference's probe values (timestamps, decimals,
NULL vs '', float specials)."""

import datetime as dt
import math
import tempfile
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillpoint.plans import quality as q
from tillpoint.sources import testdata as td


def _roundtrip(spark, df):
    d = tempfile.mkdtemp(prefix="tillpoint-q-")
    df.write.mode("overwrite").parquet(d)
    return spark.read.parquet(d)


def test_q5_timestamp_fidelity_micros_and_ns_truncation(spark):
    src = spark.createDataFrame([(1, dt.datetime(2024, 3, 15, 12, 34, 56, 123456))], "id int, ts timestamp_ntz")
    out = q.check_columns_equal(src, _roundtrip(spark, src), "probe", "id", ["ts"]).collect()
    assert out[0].passed
    ns = spark.createDataFrame([(1, "2024-03-15 12:34:56.123456789")], "id int, s string").select(
        "id", F.to_timestamp_ntz("s").alias("ts"))
    assert ns.collect()[0].ts == dt.datetime(2024, 3, 15, 12, 34, 56, 123456)


def test_q6_decimal_fidelity_and_declared_rounding(spark):
    src = spark.createDataFrame([(1, D("0.123456789012345678"))], "id int, x decimal(38,18)")
    assert q.check_columns_equal(src, _roundtrip(spark, src), "probe", "id", ["x"], "Q6_decimal").first().passed
    narrow = src.select("id", F.col("x").cast("decimal(5,4)").alias("x"))
    assert narrow.first().x == D("0.1235")
    chk = q.check_columns_equal(src, narrow, "probe", "id", ["x"], "Q6_decimal",
                                target_expr={"x": F.col("x").cast("decimal(5,4)")})
    assert chk.first().passed


def test_q7_null_and_empty_stay_distinct(spark):
    src = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "id int, s string")
    prof = {r.column: r for r in q.null_empty_profile(_roundtrip(spark, src), "probe").collect()}
    assert (prof["s"].nulls, prof["s"].empties) == (1, 1)
    assert all(r.passed for r in q.check_null_empty_preserved(src, _roundtrip(spark, src), "probe").collect())


def test_q8_float_specials(spark):
    vals = [float("nan"), float("inf"), float("-inf"), -0.0, 0.30000000000000004, None]
    src = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, x double")
    back = _roundtrip(spark, src)
    r = q.float_classes(back, "probe", ["x"]).first()
    assert (r.nan, r.pos_inf, r.neg_inf, r.neg_zero, r.nulls) == (1, 1, 1, 1, 1)
    got = {row.id: row.x for row in back.collect()}
    assert math.isnan(got[0]) and math.copysign(1.0, got[3]) == -1.0 and got[4] == 0.30000000000000004


def test_q1_q4_q9(spark):
    cat = {(r.object, r.passed, r.detail) for r in
           q.check_catalog(spark, ["fact_sales", "dim_date"], ["fact_sales", "tmp_x"]).collect()}
    assert cat == {("fact_sales", True, "present"), ("dim_date", False, "missing"), ("tmp_x", False, "unexpected")}
    dup = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    assert q.check_unique(dup, "t", ["k"]).first().detail == "2 duplicated keys, 4 rows"
    fs = td.fact_sales(spark, SF_SMALL).select("invoice_no", "quantity", "sale_date")
    changed = fs.withColumn("quantity", F.when(F.col("invoice_no") == F.lit("0"), F.col("quantity") + 1)
                            .otherwise(F.col("quantity")))
    res = q.reconcile(fs, changed, "fact_sales", "sale_date")
    assert res.filter(~F.col("passed")).count() == 1


def test_q2_schema_recurses_into_structs(spark):
    from pyspark.sql import types as T
    exp = T.DataType.fromDDL("a bigint, s struct<x:int,y:string>")
    act = T.DataType.fromDDL("a bigint, s struct<x:bigint,y:string>")
    bad = [r.object for r in q.check_schema(spark, "t", exp, act).collect() if not r.passed]
    assert bad == ["t.s.x"] or sorted(bad) == ["t.s", "t.s.x"]
