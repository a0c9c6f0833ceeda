"""The production data path: write the retail tables once, with the layout
the reference declares, and run the views over the written tables.

* facts are partitioned by their date column (P1, dynamic overwrite, so a
  rerun of a day replaces that day only) and clustered by their join key
  inside each partition (P4: sorted row groups let min/max statistics skip
  data for key filters);
* dimensions are written whole (type-1 overwrite);
* views read the tables back; date filters become partition filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks as P
from ..sources import testdata as td

# table: (builder, partition column, clustering key)
LAYOUT = {
    "fact_sales": (td.fact_sales, "sale_date", "customer_sk"),
    "fact_shipments": (td.fact_shipments, "_partition_date", "warehouse_sk"),
    "fact_loyalty_events": (td.fact_loyalty_events, "event_date", "member_id"),
    "dim_customer": (td.dim_customer, None, "customer_sk"),
    "dim_product": (td.dim_product, None, "product_sk"),
    "dim_store": (td.dim_store, None, "store_sk"),
}


def write_tables(spark: SparkSession, sf_dir: str, root: str, tables: list[str] | None = None) -> None:
    for name in tables or list(LAYOUT):
        build, part, key = LAYOUT[name]
        df = build(spark, sf_dir)
        if part:
            # one range-partitioned task per slice of (date, key): files of a
            # day are sorted by the key, and no task holds more than its range
            df = df.repartitionByRange(part, key).sortWithinPartitions(part, key)
            P.write_partitioned(df, f"{root}/{name}", [part])
        else:
            P.clustered(df, [key]).write.mode("overwrite").parquet(f"{root}/{name}")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def fact_sales_at(spark: SparkSession, root: str) -> DataFrame:
    """fact_sales with its declared column order (partition column last)."""
    t = table(spark, root, "fact_sales")
    return t.select(*[c for c in t.columns if c != "sale_date"], F.col("sale_date"))
