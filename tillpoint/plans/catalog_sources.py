"""Registered round trips of the readers, partition columns and typing: a
given or derived table is written as its landing format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import register
from ..session import scratch_table
from ..sources import readers as rd
from ..sources import sinks as sk
from ..sources import testdata as td
from . import quality as q

_CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.IntegerType()),
                          T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())])
_NAMES = _CUSTOMER.fieldNames()


def _customers(spark, sf):
    """Customers, some with an empty and some without a segment."""
    segment = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    return spark.read.parquet(f"{sf}/customer.parquet").withColumn("c_mktsegment", segment).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in _CUSTOMER.fields])


_CUSTOMER_SQL = """
SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment
FROM customer"""


def _tokens(df):
    return [F.coalesce(F.col(c).cast("string"), F.lit(rd.NULL_TOKEN)) for c in df.columns]


@register("R1_delimited_text", _CUSTOMER_SQL)
def q_r1(spark, sf):
    path, src = scratch_table(spark, "customer_tsv"), _customers(spark, sf)
    src.select(F.concat_ws("\t", *_tokens(src)).alias("value")).write.text(path)
    return rd.read_delimited_text(spark, path, _CUSTOMER).filter("_bad_fields = 0").drop("_bad_fields")


def _csv(spark, sf):
    path, src = scratch_table(spark, "customer_csv"), _customers(spark, sf)
    src.select(*[c.alias(n) for c, n in zip(_tokens(src), src.columns)]).write.option("header", True).option("emptyValue", "").csv(path)
    return rd.read_csv(spark, path, _CUSTOMER)


@register("R2_csv", _CUSTOMER_SQL)
def q_r2(spark, sf):
    return _csv(spark, sf).filter("_corrupt_record IS NULL").drop("_corrupt_record")


@register("R3_json_lines", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_r3(spark, sf):
    path, src = scratch_table(spark, "events_json"), spark.read.parquet(f"{sf}/events.parquet")
    src.write.option("timestampNTZFormat", rd.TS_MICROS).json(path)
    return rd.read_json_lines(spark, path, src.schema).filter("_corrupt_record IS NULL").select("event_id", "ts", "user_id", "event_type", "value", "props")


@register("R4_regex_lines", "SELECT event_ts_str, member_id, event_type, points, store_id, tx_id, meta_raw FROM fx_loyalty_raw")
def q_r4(spark, sf):
    path, raw = scratch_table(spark, "loyalty_log"), td.loyalty_events_raw(spark, sf)
    raw.select(F.concat_ws("|", *rd.LOYALTY_FIELDS).alias("value")).write.text(path)
    return rd.read_regex_lines(spark, path).filter("_matched").select(*rd.LOYALTY_FIELDS[:-1])


@register("P2_partition_columns", """
SELECT shipment_id, CAST(shipped_ts AS DATE) AS by_day, CAST(date_trunc('month', shipped_ts) AS DATE) AS by_month,
       CAST(date_trunc('year', shipped_ts) AS DATE) AS by_year, strftime(shipped_ts, '%Y%m%d_%H') AS by_hour
FROM fx_shipments""")
def q_p2(spark, sf):
    s = td.fact_shipments(spark, sf)
    for grain in ("day", "month", "year", "hour"):
        s = sk.with_partition_column(s, f"by_{grain}", "shipped_ts", grain)
    return s.select("shipment_id", "by_day", "by_month", "by_year", "by_hour")


@register("P5_typed_columns", """
SELECT CAST(tx_id AS BIGINT) AS tx_id, TRY_CAST(points AS BIGINT) AS points, TRY_CAST(event_ts_str AS TIMESTAMP) AS event_ts_str, member_id,
       CAST(NULL AS DECIMAL(10,2)) AS fee
FROM fx_loyalty_raw""")
def q_p5(spark, sf):
    declared = T.StructType([T.StructField("tx_id", T.LongType()), T.StructField("points", T.LongType()), T.StructField("event_ts_str", T.TimestampNTZType()),
                             T.StructField("member_id", T.StringType()), T.StructField("fee", T.DecimalType(10, 2))])
    return sk.typed(td.loyalty_events_raw(spark, sf), declared)


@register("Q5_fidelity_of_csv", f"""
WITH customers AS ({_CUSTOMER_SQL})
SELECT 'Q5_fidelity' AS "check", 'customer.' || c AS object, TRUE AS passed, '0 values differ' AS detail, n AS row_count
FROM (SELECT COUNT(*) AS n FROM customers) t, (VALUES {', '.join(f"('{n}')" for n in _NAMES[1:])}) v(c)""")
def q_q5(spark, sf):
    src = _customers(spark, sf)
    found = q.check_columns_equal(src, _csv(spark, sf).drop("_corrupt_record"), "customer", "c_custkey", _NAMES[1:])
    return found.withColumn("row_count", F.lit(src.count()))


# Amounts are declared with two places; the source has more (ours: two rates).
_RATES = {"interest": "0.0333", "fee": "0.0175"}


@register("Q6_rounding_of_amounts", """
SELECT 'Q6_rounding' AS "check", 'customer.' || c AS object, TRUE AS passed, '0 values differ' AS detail, n AS row_count
FROM (SELECT COUNT(*) AS n FROM customer) t, (VALUES ('interest'), ('fee')) v(c)""")
def q_q6(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    exact = customers.select("c_custkey", *[(F.col("c_acctbal").cast("decimal(12,2)") * F.lit(r).cast("decimal(5,4)")).alias(n) for n, r in _RATES.items()])
    path = scratch_table(spark, "amounts")
    exact.select("c_custkey", *[F.col(n).cast("decimal(14,2)").alias(n) for n in _RATES]).write.parquet(path)
    rounded = {n: F.round(F.col(n), 2).cast("decimal(14,2)") for n in _RATES}
    found = q.check_columns_equal(exact, spark.read.parquet(path), "customer", "c_custkey", list(_RATES), "Q6_rounding", rounded)
    return found.withColumn("row_count", F.lit(customers.count()))
