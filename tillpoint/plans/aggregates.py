"""A1-A10: aggregate-table jobs, plus the bridge they need (B2).

The reference gives only the result schemas of these tables (their load
SQL is not in it), so every formula here is our design, stated in the
docstrings.  Decimal ratios round HALF_UP to the declared scale through
:func:`functions.numeric.decimal_ratio`.
"""

from __future__ import annotations

import datetime as dt
import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import decimal_ratio
from ..operators.joins import trailing_agg
from ..session import written


# B2 -------------------------------------------------------------------------
def bridge_product_supplier(offers: DataFrame) -> DataFrame:
    """Primary supplier per product = lowest unit cost, then shortest lead
    time, then lowest supplier key.  The window holds one product's offers
    (bounded by its supplier count)."""
    w = Window.partitionBy("product_sk").orderBy(
        F.col("unit_cost").asc_nulls_last(), F.col("lead_time_days").asc_nulls_last(),
        F.col("supplier_sk").asc())
    return offers.select(
        "product_sk", "supplier_sk", (F.row_number().over(w) == 1).alias("primary_supplier"),
        "supplier_sku", "unit_cost", "lead_time_days", "moq", "valid_from", "valid_to")


# A1 / A9 --------------------------------------------------------------------
def cube_table(df: DataFrame, dims: list[str], measures: list[Column],
               level_col: str = "dim_level", key_col: str | None = "cube_key",
               sep: str = "|") -> DataFrame:
    """CUBE over ``dims`` with the grouping id and a text key naming the
    cell: a rolled-up dimension reads '*', a NULL leaf value reads ''."""
    aggs = [*measures, F.grouping_id(*dims).alias(level_col)]
    if key_col:
        parts = [F.when(F.grouping(d) == 1, F.lit("*"))
                 .otherwise(F.coalesce(F.col(d).cast("string"), F.lit(""))) for d in dims]
        aggs.append(F.concat_ws(sep, *parts).alias(key_col))
    return df.cube(*dims).agg(*aggs)


def cube_lattice(df: DataFrame, dims: list[str], sums: dict[str, Column], distinct: tuple[str, str] | None = None,
                 level_col: str = "dim_level", key_col: str | None = "cube_key", sep: str = "|") -> DataFrame:
    """The cube of :func:`cube_table` with every grouping set computed from a
    smaller one instead of from the rows: ``sums`` (output -> column) and
    ``distinct`` (output, column), an exact count of distinct values.

    Rows are read once, into the finest grouping (with the distinct column).
    A set's sums are the sums of any set with one more dimension.  Distinct
    counts add up over a dropped dimension if no value stands under two of
    its members, as an order has one country.  Which dimensions depend on the
    distinct column in this way is looked up in all the data (one row of
    booleans); over others the set goes through its own distinct values,
    taken from the smallest table that has them.  Of several parents the one
    whose dimensions have the fewest members is used.  The finest grouping is
    written; the sets above it are one query whose exchanges are shared.  The
    cells of all dimensions are dealt once by the dimension with the most
    members, so no set with that dimension needs an exchange of its own; a
    member has at most a row per combination of the others there."""
    out, d = distinct or (None, None)
    extra = [d] if d else []
    names = list(sums)
    base = written(df.groupBy(*dims, *extra).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "cube")
    members = base.agg(*[F.approx_count_distinct(x).alias(x) for x in dims]).first()

    def own(t: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
        # over no rows there is no grand total either
        return t.groupBy(*(by or [F.lit(0).alias("__all")])).agg(*[F.sum(n).alias(n) for n in names], *aggs)

    depends = set(dims)
    if d:
        each = base.filter(F.col(d).isNotNull()).groupBy(d).agg(*[
            (F.min(x).eqNullSafe(F.max(x)) & F.count(x).isin(F.lit(0), F.count(F.lit(1)))).alias(x) for x in dims])
        depends = {x for x, one in each.agg(*[F.every(x).alias(x) for x in dims]).first().asDict().items() if one is not False}
    counted = [F.count(d).alias(out)] if d else []
    full = tuple(dims)
    bases = {full: base}
    cells = {full: own(base, dims, *counted).repartition(max(dims, key=lambda x: members[x] or 0))}
    for width in range(len(dims) - 1, -1, -1):
        for keep in itertools.combinations(dims, width):
            gone = [x for x in dims if x not in keep]
            adds = [x for x in gone if x in depends]
            if adds:
                x = min(adds, key=lambda x: members[x])
                cells[keep] = own(cells[tuple(y for y in dims if y in keep or y == x)], list(keep), *([F.sum(out).alias(out)] if d else []))
            else:
                parent = min((s for s in bases if set(keep) < set(s)), key=lambda s: math.prod(members[x] or 1 for x in s))
                bases[keep] = own(bases[parent], [*keep, *extra])
                cells[keep] = own(bases[keep], list(keep), *counted)

    def shown(keep: tuple, t: DataFrame) -> DataFrame:
        level = sum(1 << (len(dims) - 1 - i) for i, x in enumerate(dims) if x not in keep)
        columns = [F.col(x) if x in keep else F.lit(None).cast(df.schema[x].dataType).alias(x) for x in dims]
        aggs = [F.coalesce(F.col(out), F.lit(0)).cast("bigint").alias(out)] if d else []
        key = F.concat_ws(sep, *[F.coalesce(F.col(x).cast("string"), F.lit("")) if x in keep else F.lit("*") for x in dims])
        return t.select(*columns, *aggs, *names, F.lit(level).alias(level_col), *([key.alias(key_col)] if key_col else []))

    return reduce(DataFrame.unionByName, [shown(k, t) for k, t in cells.items()])


def sales_cube(fact_sales: DataFrame, as_of: dt.date) -> DataFrame:
    """country x month x product cube of sales up to ``as_of``."""
    f = fact_sales.filter(F.col("sale_date") <= F.lit(as_of)).withColumn(
        "month_key", (F.year("sale_date") * 100 + F.month("sale_date")).cast("bigint"))
    c = cube_lattice(f, ["country", "month_key", "product_sk"], {"revenue": F.col("line_total"), "units": F.col("quantity")},
                     ("orders", "invoice_no")).withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))
    return c.select(F.col("dim_level").cast("bigint").alias("dim_level"), "cube_key", "country",
                    "month_key", "product_sk", "orders", "revenue", "units",
                    F.lit(as_of).alias("as_of_date"))


# A2 -------------------------------------------------------------------------
def top_countries_daily(fact_sales: DataFrame, k: int = 5) -> DataFrame:
    """Per day, countries by revenue (ties: country name), top ``k``.  The
    window sees one row per (day, country)."""
    daily = fact_sales.groupBy("sale_date", "country").agg(
        F.count_distinct("invoice_no").alias("orders"),
        F.sum("line_total").cast("decimal(18,2)").alias("revenue"))
    w = Window.partitionBy("sale_date").orderBy(F.col("revenue").desc_nulls_last(),
                                               F.col("country").asc_nulls_last())
    return (daily.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= k)
            .select(F.col("sale_date").alias("as_of_date"), "country", "orders", "revenue", "rank"))


# A3 -------------------------------------------------------------------------
def daily_sales_by_store(fact_sales: DataFrame, fact_returns: DataFrame) -> DataFrame:
    """gross = sum of line totals, net = gross - refunds of returns booked
    on that store and day, avg_basket = gross / distinct invoices.  Days
    with only returns appear with gross 0."""
    s = fact_sales.groupBy("store_sk", "sale_date").agg(
        F.sum("line_total").alias("gross"), F.sum("quantity").alias("units"),
        F.count_distinct("invoice_no").alias("txns"))
    r = fact_returns.groupBy("store_sk", F.col("return_date").alias("sale_date")).agg(
        F.sum("refund_amount").alias("refunds"))
    j = s.join(r, ["store_sk", "sale_date"], "full_outer")
    gross = F.coalesce(F.col("gross"), F.lit(0))
    txns = F.coalesce(F.col("txns"), F.lit(0))
    return j.select(
        "store_sk",
        gross.cast("decimal(16,2)").alias("gross_revenue"),
        (gross - F.coalesce(F.col("refunds"), F.lit(0))).cast("decimal(16,2)").alias("net_revenue"),
        F.coalesce(F.col("units"), F.lit(0)).alias("units_sold"),
        txns.alias("txn_count"),
        decimal_ratio(gross, txns, 12, 2, num_scale=2).alias("avg_basket"),
        "sale_date")


# A4 -------------------------------------------------------------------------
def daily_sales_by_product(fact_sales: DataFrame, fact_returns: DataFrame,
                           bridge: DataFrame) -> DataFrame:
    """cogs = units x primary-supplier unit cost; margin = (gross - cogs) /
    gross; returns by return day; net units = sold - returned."""
    s = fact_sales.groupBy("product_sk", "sale_date").agg(
        F.sum("quantity").alias("units"), F.sum("line_total").alias("gross"))
    r = fact_returns.groupBy("product_sk", F.col("return_date").alias("sale_date")).agg(
        F.sum("quantity").alias("ret"))
    cost = bridge.filter("primary_supplier").select("product_sk", "unit_cost")
    j = s.join(r, ["product_sk", "sale_date"], "full_outer").join(cost, "product_sk", "left")
    units = F.coalesce(F.col("units"), F.lit(0))
    gross = F.coalesce(F.col("gross"), F.lit(0)).cast("decimal(16,2)")
    cogs = (units * F.col("unit_cost")).cast("decimal(16,2)")
    ret = F.coalesce(F.col("ret"), F.lit(0))
    return j.select(
        "product_sk", units.alias("units_sold"), gross.alias("gross_revenue"),
        decimal_ratio(gross - cogs, gross, 6, 4, num_scale=2, den_scale=2).alias("margin_pct"),
        cogs.alias("cogs"), ret.alias("return_units"), (units - ret).alias("net_units"),
        "sale_date")


# A5 -------------------------------------------------------------------------
# Fixed thresholds for the three RFM digits (5 = best); ours, parameters.
RECENCY_DAYS = (30, 90, 180, 365)          # <= each bound: 5, 4, 3, 2; else 1
FREQUENCY_ORDERS = (20, 10, 5, 2)          # >= each bound: 5, 4, 3, 2; else 1
MONETARY_LTV = (2_000_000, 1_000_000, 500_000, 100_000)


def _digit(c: Column, bounds: tuple, le: bool) -> Column:
    e = None
    for i, b in enumerate(bounds):
        cond = c <= b if le else c >= b
        e = F.when(cond, F.lit(5 - i)) if e is None else e.when(cond, F.lit(5 - i))
    return e.otherwise(F.lit(1)).cast("string")


def _quintile(c: Column, cuts: Column) -> Column:
    """1 to 5: one more than the number of cutoffs below the value."""
    return F.size(F.filter(cuts, lambda x: x < c)) + 1


def weekly_customer_ltv(fact_sales: DataFrame, as_of: dt.date, quintiles: bool = False) -> DataFrame:
    """The weekly snapshot written for the week of ``as_of`` (one partition
    per weekly run): per customer with sales up to ``as_of`` - lifetime
    value, orders, average order value, days since last order, an RFM code
    of three digits from fixed thresholds, churn risk = min(1, days/365).
    With ``quintiles`` each digit is the customer's quintile (5 = best), by
    the four ``approx_percentile`` cutoffs over all customers (exact up to
    10,000 distinct values of a measure, within 1 / 10,000 of all ranks
    beyond); a value equal to a cutoff is below it.  The twelve cutoffs come
    to the driver as one row and go on as literals."""
    f = fact_sales.filter((F.col("sale_date") <= F.lit(as_of)) & F.col("customer_sk").isNotNull())
    per = f.groupBy("customer_sk").agg(
        F.sum("line_total").alias("ltv"), F.count_distinct("invoice_no").alias("orders"),
        F.max("sale_date").alias("last"))
    days = F.datediff(F.lit(as_of), F.col("last")).cast("bigint")
    rfm = F.concat(_digit(days, RECENCY_DAYS, True), _digit(F.col("orders"), FREQUENCY_ORDERS, False),
                   _digit(F.col("ltv"), MONETARY_LTV, False))
    if quintiles:
        per = per.checkpoint()  # read twice: cutoffs, then digits
        measures = {"r": days, "f": F.col("orders"), "m": F.col("ltv")}
        cuts = per.agg(*[F.percentile_approx(c, [0.2, 0.4, 0.6, 0.8], 10_000).alias(n) for n, c in measures.items()]).first()
        digits = {n: _quintile(c, F.array(*[F.lit(x) for x in cuts[n] or ()])) for n, c in measures.items()}
        rfm = F.concat(*[d.cast("string") for d in (6 - digits["r"], digits["f"], digits["m"])])
    return per.select(
        "customer_sk", F.col("ltv").cast("decimal(16,2)").alias("ltv_to_date"),
        F.col("orders").alias("orders_to_date"),
        decimal_ratio(F.col("ltv"), F.col("orders"), 12, 2, num_scale=2).alias("avg_order_value"),
        days.alias("days_since_last_order"), rfm.alias("rfm_score"),
        decimal_ratio(F.least(days, F.lit(365)), F.lit(365), 4, 3).alias("churn_risk"),
        F.date_trunc("week", F.lit(as_of)).cast("date").alias("week_start_date"))


# A8 -------------------------------------------------------------------------
def daily_carrier_otd(fact_shipments: DataFrame, sla_hours: int = 48) -> DataFrame:
    """Per carrier and ship day: on time (delivered within SLA), late,
    in transit (not delivered, kept apart unlike V11); otd_pct over
    delivered shipments; mean transit hours of delivered ones."""
    due = F.timestamp_add("HOUR", F.lit(sla_hours), F.col("shipped_ts"))
    delivered = F.col("delivered_ts").isNotNull()
    secs = F.unix_seconds(F.col("delivered_ts").cast("timestamp")) - F.unix_seconds(
        F.col("shipped_ts").cast("timestamp"))
    g = fact_shipments.groupBy("carrier", F.to_date("shipped_ts").alias("ship_date")).agg(
        F.count(F.lit(1)).alias("shipments_total"),
        F.count(F.when(delivered & (F.col("delivered_ts") <= due), 1)).alias("delivered_on_time"),
        F.count(F.when(delivered & (F.col("delivered_ts") > due), 1)).alias("delivered_late"),
        F.count(F.when(~delivered, 1)).alias("in_transit"),
        F.sum(secs).alias("__secs"))
    n_del = F.col("delivered_on_time") + F.col("delivered_late")
    return g.select(
        "carrier", "shipments_total", "delivered_on_time", "delivered_late", "in_transit",
        decimal_ratio(F.col("delivered_on_time"), n_del, 5, 4).alias("otd_pct"),
        decimal_ratio(F.col("__secs"), n_del * 3600, 8, 2).alias("avg_transit_hours"),
        "ship_date")


# A10 ------------------------------------------------------------------------
def returns_by_reason_monthly(fact_returns: DataFrame, fact_sales: DataFrame) -> DataFrame:
    """Returns matched to their sale by (invoice, product); the sale side is
    reduced to one row per key first (first sale day), so duplicate sale
    lines cannot multiply a return."""
    sale = fact_sales.groupBy("invoice_no", "product_sk").agg(F.min("sale_date").alias("sold_on"))
    j = fact_returns.join(sale, ["invoice_no", "product_sk"], "left")
    days = F.datediff(F.col("return_date"), F.col("sold_on"))
    g = j.groupBy("reason_code", F.trunc("return_date", "month").alias("month_start")).agg(
        F.count(F.lit(1)).alias("return_count"), F.sum("quantity").alias("return_units"),
        F.sum("refund_amount").cast("decimal(16,2)").alias("total_refunded"),
        F.sum(days).alias("__days"), F.count(days).alias("__n"))
    return g.select("reason_code", "return_count", "return_units", "total_refunded",
                    decimal_ratio(F.col("__days"), F.col("__n"), 8, 2).alias("avg_days_to_return"),
                    "month_start")


# A6 -------------------------------------------------------------------------
def monthly_supplier_performance(receipts: DataFrame, sla_hours: int = 48) -> DataFrame:
    """Per supplier and month: distinct orders, units, on-time share of the
    delivered lines, share of filled lines (status F), mean lead time in
    days of delivered lines, quality = share not returned, spend."""
    delivered = F.col("delivered_ts").isNotNull()
    on_time = delivered & (F.col("delivered_ts") <= F.timestamp_add("HOUR", F.lit(sla_hours), F.col("shipped_ts")))
    secs = F.unix_seconds(F.col("delivered_ts").cast("timestamp")) - F.unix_seconds(F.col("shipped_ts").cast("timestamp"))
    g = receipts.groupBy("supplier_sk", F.trunc("shipped_ts", "month").alias("month_start")).agg(
        F.count_distinct("l_orderkey").alias("orders_placed"), F.sum("quantity").alias("units_received"),
        F.count(F.when(on_time, 1)).alias("__ot"), F.count(F.when(delivered, 1)).alias("__dl"),
        F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("__f"), F.count(F.lit(1)).alias("__n"),
        F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("__ok"), F.sum(secs).alias("__s"),
        F.sum("line_total").alias("__spend"))
    return g.select(
        "supplier_sk", "orders_placed", "units_received",
        decimal_ratio(F.col("__ot"), F.col("__dl"), 5, 4).alias("on_time_pct"),
        decimal_ratio(F.col("__f"), F.col("__n"), 5, 4).alias("fill_rate_pct"),
        decimal_ratio(F.col("__s"), F.col("__dl") * 86400, 6, 2).alias("avg_lead_time_days"),
        decimal_ratio(F.col("__ok"), F.col("__n"), 4, 3).alias("quality_score"),
        F.col("__spend").cast("decimal(16,2)").alias("total_spend"), "month_start")


# A9 -------------------------------------------------------------------------
# Fixed values (ours): cost per attributed order by channel.
CHANNEL_COST = {"search": "1.20", "mail": "0.30", "social": "0.80", "direct": "0.00"}


def channel_of(referrer: Column) -> Column:
    host = F.regexp_extract(referrer, r"^https?://([a-z]+)\.", 1)
    return F.when(referrer.isNull() | (host == ""), F.lit("direct")).otherwise(host)


def last_touch(sales: DataFrame, touches: DataFrame, within_days: int = 1) -> DataFrame:
    """Per order (``invoice_no``, ``customer_sk``, ``invoice_ts``,
    ``line_total``): the latest session event of the same customer at most
    ``within_days`` before it, as struct ``t`` (event_ts, referrer,
    campaign_sk, region); orders no event reached are dropped.  The latest
    event is a max over (time, payload), so it runs as a trailing aggregate
    and the (event, order) pairs are never built.  The lines of an order are
    summed first, so an order counts once with all its lines."""
    per_order = sales.groupBy("invoice_no", "customer_sk", "invoice_ts").agg(
        F.sum("line_total").cast(sales.schema["line_total"].dataType).alias("line_total"))
    t = trailing_agg(per_order, touches,
                     ["invoice_no", "customer_sk", "invoice_ts"], "customer_sk", "customer_sk", "invoice_ts", "event_ts", within_days * 86400,
                     maxes={"t": F.struct("event_ts", "referrer", "campaign_sk", "region")})
    return t.filter(F.col("t").isNotNull())


def marketing_attribution_cube(last: DataFrame, as_of: dt.date) -> DataFrame:
    """Last-touch attribution: each order goes to the latest session event
    that reached it (:func:`last_touch`); channel from the referrer host,
    campaign from that event; cube over channel x campaign x region with
    cost per attributed order and roas = revenue / cost."""
    cost = None
    for k, v in CHANNEL_COST.items():
        c = channel_of(F.col("t.referrer")) == k
        cost = F.when(c, F.lit(v)) if cost is None else cost.when(c, F.lit(v))
    x = last.select(channel_of(F.col("t.referrer")).alias("channel"), F.col("t.campaign_sk").alias("campaign_sk"),
                    F.col("t.region").alias("region"), "line_total", cost.cast("decimal(6,2)").alias("__cost"))
    c = cube_lattice(x, ["channel", "campaign_sk", "region"], {
        "attributed_revenue": F.col("line_total"), "attributed_units": F.lit(1).cast("bigint"), "cost": F.col("__cost")},
        level_col="grouping_id", key_col=None)
    c = c.withColumns({"attributed_revenue": F.col("attributed_revenue").cast("decimal(16,2)"), "cost": F.col("cost").cast("decimal(14,2)"),
                       "grouping_id": F.col("grouping_id").cast("bigint")})
    return c.select("channel", "campaign_sk", "region", "attributed_revenue", "attributed_units", "cost",
                    decimal_ratio(F.col("attributed_revenue"), F.col("cost"), 8, 4, num_scale=2, den_scale=2)
                    .alias("roas"), "grouping_id", F.lit(as_of).alias("period_date"))
