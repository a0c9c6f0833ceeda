"""D3 and F10 as data: one job loads every type-1 dimension, one every
further fact.

A dimension is its natural key, its surrogate key, its attributes and the
deliveries of its feed; deliveries are applied one after the other by
:func:`plans.facts.type1_dimension`, so known keys keep their number.  A fact
is its lookups and typed columns (:func:`plans.facts.typed_fact`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import testdata as td
from .facts import type1_dimension, typed_fact

Feed = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Dimension:
    """``feed`` has ``delivery`` (0, 1, ...), the natural key and attributes,
    one row per delivery and key."""

    natural: str
    sk: str
    attrs: dict[str, str]  # name -> type
    feed: Feed


def load_dimension(spec: Dimension, feed: DataFrame, deliveries: int = 2) -> DataFrame:
    """The dimension after its deliveries."""
    types = ", ".join(f"{n} {t}" for n, t in {spec.sk: "bigint", spec.natural: "string", **spec.attrs}.items())
    dim = feed.sparkSession.createDataFrame([], types)
    typed = feed.select("delivery", F.col(spec.natural).cast("string"), *[F.col(n).cast(t).alias(n) for n, t in spec.attrs.items()]).checkpoint()
    for k in range(deliveries):
        dim = type1_dimension(dim, typed.filter(F.col("delivery") == k).drop("delivery"), spec.natural, spec.sk, list(spec.attrs)).checkpoint()
    return dim


def _twice(df: DataFrame, first: Column) -> DataFrame:
    """A first delivery of some rows, a second one of all."""
    return df.withColumn("delivery", F.explode(F.when(first, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))


def _catalog(spark, sf, key: Column, name: str, **attrs: Column) -> DataFrame:
    feed = td.product_catalog_feed(spark, sf).withColumn("delivery", F.when(F.col("feed_date") == "20010201", 1).otherwise(0))
    return feed.groupBy("delivery", key.alias(name)).agg(*[c.alias(n) for n, c in attrs.items()])


def _brands(spark, sf):
    return _catalog(spark, sf, F.upper(F.trim("subcategory")), "brand_id", brand_name=F.max(F.trim("subcategory")), launch_dt=F.min("available_from"))


def _colors(spark, sf):
    return _catalog(spark, sf, F.lower(F.trim("color")), "color_code", color_name=F.max(F.trim("color")))


def _sizes(spark, sf):
    code = F.trim("size")
    return _catalog(spark, sf, code, "size_code", size_name=F.max(F.concat(F.lit("Size "), code)), sort_order=F.max(code.try_cast("bigint")))


def _suppliers(spark, sf):
    terms = td.supplier_terms_snapshots(spark, sf).groupBy("supplier_sk").agg(F.max_by("payment_terms_days", "eff_ts").alias("payment_terms_days"))
    s, n = td._read(spark, sf, "supplier"), td._read(spark, sf, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(terms, s.s_suppkey == terms.supplier_sk, "left")
    return _twice(j.select(F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string")).alias("supplier_id"), F.col("s_name").alias("supplier_name"),
                           F.col("n_name").alias("country"), "payment_terms_days", "s_suppkey"), F.col("s_suppkey") % 3 != 0)


def _stores(spark, sf):
    return _twice(td.dim_store(spark, sf).withColumn("n", F.col("store_sk")), F.col("n") % 2 == 0)


WAREHOUSE_SPLIT = dt.datetime(1995, 6, 17)


def _warehouses(spark, sf):
    m = _twice(td.inventory_movements(spark, sf), F.col("movement_ts") < F.lit(WAREHOUSE_SPLIT))
    return m.groupBy("delivery", "warehouse_id").agg(F.max("operator_id").alias("operator"), F.count_distinct("bin_location").alias("bins"),
                                                     F.to_date(F.min("movement_ts")).alias("open_dt"))


EMPLOYEE_SPLIT = 1996


def _employees(spark, sf):
    e = _twice(td.employee_year_snapshots(spark, sf), F.col("yr") < EMPLOYEE_SPLIT)
    last = F.max(F.struct("yr", "role", "department", "home_store_sk", "salary_band"))
    g = e.groupBy("delivery", F.concat(F.lit("EMP"), F.col("employee_sk").cast("string")).alias("employee_id")).agg(
        last.alias("l"), F.min("eff_date").alias("hire_dt"))
    return g.select("delivery", "employee_id", "l.role", "l.department", "l.home_store_sk", "l.salary_band", "hire_dt")


# Fixed values (ours): category and fee (share, flat) of a tender.
TENDER_FEES = {"CARD": ("card", "0.0150", "0.10"), "CASH": ("cash", "0.0000", "0.00"), "GIFT": ("stored value", "0.0050", "0.00")}


def _fee(part: int, kind: str) -> Column:
    m = F.create_map(*[x for t, f in TENDER_FEES.items() for x in (F.lit(t), F.lit(f[part]))])
    return F.try_element_at(m, F.col("tender_type")).cast(kind)


def _payment_methods(spark, sf):
    t = _twice(td.pos_transactions(spark, sf).select("tender_type").distinct(), F.col("tender_type") != "CASH")
    return t.select("delivery", F.col("tender_type").alias("method_code"), F.lower("tender_type").alias("method_name"), _fee(0, "string").alias("category"),
                    _fee(1, "decimal(5,4)").alias("fee_pct"), _fee(2, "decimal(8,2)").alias("fee_flat"))


def _promotions(spark, sf):
    p = _twice(td.promo_feed(spark, sf), F.col("ts") < F.lit(td.FEED_SPLIT))

    def day(ms: Column) -> Column:
        return F.to_date(F.timestamp_millis(ms))

    return p.groupBy("delivery", "promo_id").agg(day(F.min("valid_from_ts")).alias("start_dt"), day(F.max("valid_to_ts")).alias("end_dt"))


def _places(spark, sf):
    g = td.dim_geography(spark, sf)
    key = F.concat_ws("|", "country_iso2", F.coalesce("city", F.lit("")), F.coalesce("postal_code", F.lit("")))
    return _twice(g.withColumn("place", key), F.col("latitude") < 0)


def _categories(spark, sf):
    return _twice(td.dim_category(spark, sf).select("category_id", "parent_id", "name"), F.coalesce("parent_id", F.lit("")) == "")


DIMENSIONS = {
    "dim_brand": Dimension("brand_id", "brand_sk", {"brand_name": "string", "launch_dt": "date"}, _brands),
    "dim_color": Dimension("color_code", "color_sk", {"color_name": "string"}, _colors),
    "dim_size": Dimension("size_code", "size_sk", {"size_name": "string", "sort_order": "bigint"}, _sizes),
    "dim_supplier": Dimension("supplier_id", "supplier_sk", {"supplier_name": "string", "country": "string", "payment_terms_days": "bigint"}, _suppliers),
    "dim_store": Dimension("store_id", "store_sk", {"store_name": "string", "store_type": "string", "region": "string", "country": "string"}, _stores),
    "dim_warehouse": Dimension("warehouse_id", "warehouse_sk", {"operator": "string", "bins": "bigint", "open_dt": "date"}, _warehouses),
    "dim_employee": Dimension("employee_id", "employee_sk", {"role": "string", "department": "string", "home_store_sk": "bigint",
                                                             "salary_band": "string", "hire_dt": "date"}, _employees),
    "dim_payment_method": Dimension("method_code", "payment_method_sk", {"method_name": "string", "category": "string", "fee_pct": "decimal(5,4)",
                                                                         "fee_flat": "decimal(8,2)"}, _payment_methods),
    "dim_promotion": Dimension("promo_id", "promo_sk", {"start_dt": "date", "end_dt": "date"}, _promotions),
    "dim_geography": Dimension("place", "geo_sk", {"country_iso2": "string", "city": "string", "postal_code": "string", "latitude": "double",
                                                   "longitude": "double"}, _places),
    "dim_category": Dimension("category_id", "category_sk", {"parent_id": "string", "name": "string"}, _categories),
}


def dimension(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spec = DIMENSIONS[name]
    return load_dimension(spec, spec.feed(spark, sf_dir))


# Facts -----------------------------------------------------------------------
def fact_payments(pos: DataFrame, customers: DataFrame, methods: DataFrame, currency: str = "USD") -> DataFrame:
    """A payment per transaction that is not void: what was due after the
    discount, with tax; the fee is the method's share of it and its flat part,
    rounded half up.  The till feed has no currency: a parameter."""
    amount = (F.col("gross_amount") - F.col("discount_amount") + F.col("tax_amount")).cast("decimal(14,2)")
    paid = pos.filter(~F.coalesce("void_flag", F.lit(False))).withColumn("amount", amount).join(
        F.broadcast(methods.select(F.col("method_code").alias("__m"), "payment_method_sk", "fee_pct", "fee_flat")),  # one row per tender
        F.col("tender_type") == F.col("__m"), "left")
    fee = (F.col("amount") * F.col("fee_pct") + F.col("fee_flat")).cast("decimal(10,2)")
    return typed_fact(paid, {
        "payment_id": F.col("txn_id").cast("bigint"), "invoice_no": F.col("invoice_no"), "customer_sk": F.col("customer_sk"),
        "payment_method_sk": F.col("payment_method_sk"), "amount": F.col("amount"), "currency_code": F.lit(currency),
        "payment_ts": F.col("txn_ts"), "fee_amount": fee, "post_year": F.year("txn_ts").cast("bigint"), "post_month": F.month("txn_ts").cast("bigint"),
        "payment_method_partition": F.col("tender_type"),
    }, [("customer_id", customers, "customer_id", "customer_sk", "customer_sk")], ("_partition_month", F.trunc(F.col("txn_ts").cast("date"), "month")))


def fact_warehouse_picks(picks: DataFrame, warehouses: DataFrame, employees: DataFrame) -> DataFrame:
    return typed_fact(picks, {
        "pick_id": F.col("pick_id").cast("bigint"), "warehouse_sk": F.col("warehouse_sk"), "picker_sk": F.col("picker_sk"), "sku": F.col("sku"),
        "quantity": F.col("quantity").cast("bigint"), "picked_ts": F.col("picked_at"), "duration_ms": F.col("duration_ms").cast("bigint"),
        "bin_location": F.col("bin_id"), "warehouse_partition": F.col("warehouse_id_partition"),
    }, [("warehouse_id", warehouses, "warehouse_id", "warehouse_sk", "warehouse_sk"), ("picker_id", employees, "employee_id", "employee_sk", "picker_sk")],
        ("pick_date", F.to_date("picked_at")))


def fact_inventory_movements(movements: DataFrame, warehouses: DataFrame, employees: DataFrame) -> DataFrame:
    """The feed has no store; the region column of the partition is the
    warehouse's and not known either, so neither is made up."""
    return typed_fact(movements, {
        "movement_id": F.col("movement_id").cast("bigint"), "movement_ts": F.col("movement_ts"), "sku": F.col("sku"), "warehouse_sk": F.col("warehouse_sk"),
        "movement_type": F.col("movement_type"), "quantity": F.col("quantity").cast("bigint"), "reference_doc": F.col("reference_doc"),
        "operator_sk": F.col("operator_sk"), "year": F.col("year"), "month": F.col("month"), "day": F.col("day"),
    }, [("warehouse_id", warehouses, "warehouse_id", "warehouse_sk", "warehouse_sk"), ("operator_id", employees, "employee_id", "employee_sk", "operator_sk")],
        ("_partition_date", F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"))))


def fact_refunds(returns: DataFrame, payments: DataFrame, methods: DataFrame) -> DataFrame:
    """A refund per returned line, to the payment of its invoice and by the
    method that paid it; lines whose invoice has no payment keep NULLs."""
    paid = payments.select(F.col("invoice_no").alias("__invoice"), "payment_id", "customer_sk", "currency_code", F.col("payment_method_sk").alias("__method"))
    r = returns.join(paid, F.col("invoice_no") == F.col("__invoice"), "left").join(
        F.broadcast(methods.select(F.col("payment_method_sk").alias("__sk"), "method_code")), F.col("__method") == F.col("__sk"), "left")
    return typed_fact(r, {
        "invoice_no": F.col("invoice_no"), "product_sk": F.col("product_sk"), "payment_id": F.col("payment_id"), "customer_sk": F.col("customer_sk"),
        "amount": F.col("refund_amount").cast("decimal(14,2)"), "currency_code": F.col("currency_code"), "refund_ts": F.col("return_ts"),
        "refund_method": F.col("method_code"),
    }, (), ("refund_date", F.to_date("return_ts")))
