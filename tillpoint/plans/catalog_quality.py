"""Registered data-quality checks over the derived tables.  Q2 and Q11 look
at schemas and plans only, read no rows, and so are run by tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import register
from ..session import scratch_table
from ..sources.sinks import clustered
from ..sources import testdata as td
from . import facts as fx
from . import quality as q

UNIQUE_KEYS = [  # (object, fixture builder, oracle CTE, key)
    ("dim_customer", td.dim_customer, "fx_dim_customer", "customer_sk"),
    ("dim_product", td.dim_product, "fx_dim_product", "product_sk"),
    ("dim_store", td.dim_store, "fx_dim_store", "store_sk"),
    ("fact_shipments", td.fact_shipments, "fx_shipments", "shipment_id"),
    ("mobile_events", td.mobile_events, "fx_mobile_events", "event_id"),
]


def _unique_sql(obj, cte, key):
    return f"""
SELECT 'Q4_unique' AS "check", '{obj}({key})' AS object, COUNT(*) = 0 AS passed,
       CAST(COUNT(*) AS VARCHAR) || ' duplicated keys, ' || CAST(COALESCE(SUM(c), 0) AS VARCHAR) || ' rows' AS detail
FROM (SELECT {key}, COUNT(*) AS c FROM {cte} GROUP BY {key} HAVING COUNT(*) > 1) d"""


@register("Q4_key_uniqueness", "\nUNION ALL\n".join(_unique_sql(o, c, k) for o, _, c, k in UNIQUE_KEYS))
def q_q4(spark, sf):
    return reduce(DataFrame.union, [q.check_unique(b(spark, sf), o, [k]) for o, b, _, k in UNIQUE_KEYS])


@register("Q3_partition_conformance", """
SELECT 'Q3_partition' AS "check", 'fact_shipments._partition_date' AS object,
       SUM(CASE WHEN _partition_date IS NOT DISTINCT FROM CAST(shipped_ts AS DATE) THEN 0 ELSE 1 END) = 0 AS passed,
       CAST(SUM(CASE WHEN _partition_date IS NOT DISTINCT FROM CAST(shipped_ts AS DATE) THEN 0 ELSE 1 END) AS VARCHAR)
         || ' of ' || CAST(COUNT(*) AS VARCHAR) || ' rows differ' AS detail
FROM fx_shipments
UNION ALL
SELECT 'Q3_partition', 'fact_sales.sale_date',
       SUM(CASE WHEN sale_date IS NOT DISTINCT FROM CAST(invoice_ts AS DATE) THEN 0 ELSE 1 END) = 0,
       CAST(SUM(CASE WHEN sale_date IS NOT DISTINCT FROM CAST(invoice_ts AS DATE) THEN 0 ELSE 1 END) AS VARCHAR)
         || ' of ' || CAST(COUNT(*) AS VARCHAR) || ' rows differ'
FROM fx_fact_sales""")
def q_q3(spark, sf):
    return q.check_partition_column(td.fact_shipments(spark, sf), "fact_shipments", "_partition_date",
                                    F.to_date("shipped_ts")).union(
        q.check_partition_column(td.fact_sales(spark, sf), "fact_sales", "sale_date", F.to_date("invoice_ts")))


_PROFILE = [("dim_customer", td.dim_customer, "fx_dim_customer", ["customer_sk", "customer_id", "country"]),
            ("fact_sales", td.fact_sales, "fx_fact_sales",
             ["invoice_no", "customer_sk", "country", "invoice_ts", "sale_date"])]
_STRING_COLS = {"customer_id", "country", "invoice_no"}


def _profile_sql(obj, cte, cols):
    parts = []
    for c in cols:
        empties = f"SUM(CASE WHEN {c} = '' THEN 1 ELSE 0 END)" if c in _STRING_COLS else "0"
        parts.append(f"SELECT '{obj}' AS object, '{c}' AS \"column\", COUNT(*) AS row_count, "
                     f"CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, "
                     f"CAST({empties} AS BIGINT) AS empties FROM {cte}")
    return "\nUNION ALL\n".join(parts)


@register("Q7_null_empty_profile", "\nUNION ALL\n".join(_profile_sql(o, c, cols) for o, _, c, cols in _PROFILE))
def q_q7(spark, sf):
    return reduce(DataFrame.union, [q.null_empty_profile(b(spark, sf).select(*cols), o) for o, b, _, cols in _PROFILE])


_FLOATS = [("events", "value"), ("customer", "c_acctbal"), ("supplier", "s_acctbal")]


@register("Q8_float_classes", "\nUNION ALL\n".join(f"""
SELECT '{t}' AS object, '{c}' AS "column",
       CAST(SUM(CASE WHEN isnan({c}) THEN 1 ELSE 0 END) AS BIGINT) AS nan,
       CAST(SUM(CASE WHEN {c} = 'inf'::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS pos_inf,
       CAST(SUM(CASE WHEN {c} = '-inf'::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS neg_inf,
       CAST(SUM(CASE WHEN CAST({c} AS VARCHAR) = '-0.0' THEN 1 ELSE 0 END) AS BIGINT) AS neg_zero,
       CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, COUNT(*) AS row_count
FROM {t}""" for t, c in _FLOATS))
def q_q8(spark, sf):
    return reduce(DataFrame.unionByName, [q.float_classes(spark.read.parquet(f"{sf}/{t}.parquet"), t, [c])
                                          for t, c in _FLOATS])


_RECON_COLS = ["invoice_no", "customer_sk", "product_sk", "quantity", "country", "invoice_ts", "sale_date"]


@register("Q9_reconcile_sales_reload", """
WITH s AS (SELECT sale_date, COUNT(*) AS n FROM fx_fact_sales GROUP BY sale_date),
t AS (SELECT CAST(COALESCE(try_strptime(invoice_date, '%Y-%m-%d %H:%M:%S'),
                           try_strptime(invoice_date, '%m/%d/%Y %H:%M')) AS DATE) AS sale_date, COUNT(*) AS n
      FROM fx_sales_retail GROUP BY 1)
SELECT 'Q9_reconcile' AS "check", 'fact_sales.sale_date=' || CAST(COALESCE(s.sale_date, t.sale_date) AS VARCHAR) AS object,
       s.n IS NOT DISTINCT FROM t.n AS passed,
       'rows=' || CAST(COALESCE(s.n, 0) AS VARCHAR) || '/' || CAST(COALESCE(t.n, 0) AS VARCHAR) AS detail
FROM s FULL OUTER JOIN t ON s.sale_date = t.sale_date""")
def q_q9(spark, sf):
    src = td.fact_sales(spark, sf).select(*_RECON_COLS)
    reload = fx.fact_sales_load(td.sales_retail(spark, sf), td.dim_customer(spark, sf),
                                td.dim_product(spark, sf)).select(*_RECON_COLS)
    return q.reconcile(src, reload, "fact_sales", "sale_date")


def _two_layouts(spark, sf, files=16):
    """fact_sales written clustered by customer and dealt at random, read back."""
    fact, found = td.fact_sales(spark, sf).select("invoice_no", "customer_sk", "sale_date"), []
    for name, laid in (("clustered", clustered(fact, ["customer_sk"], files)), ("shuffled", fact.repartition(files, "invoice_no"))):
        path = scratch_table(spark, f"sales_{name}")
        laid.write.parquet(path)
        found.append((name, spark.read.parquet(path)))
    return found


@register("Q3b_clustering_depth", """
SELECT 'fact_sales ' || layout || '(customer_sk)' AS object, layout = 'clustered' AS passed, n AS row_count
FROM (SELECT COUNT(*) AS n FROM fx_fact_sales) f, (VALUES ('clustered'), ('shuffled')) l(layout)""")
def q_q3b(spark, sf):
    return reduce(DataFrame.unionByName, [
        q.check_clustered(t, f"fact_sales {name}", "customer_sk").select("object", "passed", "row_count") for name, t in _two_layouts(spark, sf)])


# Planted differences: lines changed, missing and extra in the reload.
_DRILL_KEY = ["invoice_no", "product_sk"]


@register("Q9b_reconcile_drill_down", """
WITH k AS (SELECT invoice_no, product_sk, sale_date, CAST(invoice_no AS BIGINT) % 997 AS r FROM fx_fact_sales)
SELECT DISTINCT invoice_no, product_sk, sale_date, CASE r WHEN 5 THEN 'missing' WHEN 6 THEN 'changed' ELSE 'extra' END AS state
FROM k WHERE r IN (5, 6)
UNION ALL
SELECT DISTINCT invoice_no || 'x', product_sk, sale_date, 'extra' FROM k WHERE r = 7""")
def q_q9b(spark, sf):
    source = td.fact_sales(spark, sf).select("invoice_no", "product_sk", "quantity", "line_total", "sale_date")
    r = F.col("invoice_no").cast("bigint") % 997
    target = source.filter(r != 5).withColumn("quantity", F.col("quantity") + F.when(r == 6, 1).otherwise(0)).unionByName(
        source.filter(r == 7).withColumn("invoice_no", F.concat("invoice_no", F.lit("x"))))
    buckets, tables = 16, []
    for name, df in (("source", source), ("target", target)):
        path = scratch_table(spark, f"drill_{name}")
        df = q.with_bucket(df.withColumn("sale_month", F.trunc("sale_date", "month")), _DRILL_KEY, buckets)
        df.repartition("__bucket").write.partitionBy("__bucket").parquet(path)
        tables.append(spark.read.parquet(path))
    plain = [t.drop("__bucket") for t in tables]
    trees = [q.hash_tree(t, "sale_month", _DRILL_KEY, buckets).checkpoint() for t in plain]
    found = q.drill_down(*tables, "sale_month", [*_DRILL_KEY, "sale_date"], q.differing_buckets(*trees).checkpoint(), buckets)
    return found.select(*_DRILL_KEY, "sale_date", "state")
