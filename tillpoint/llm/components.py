"""Connected components of links, by contraction on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)``: the label is the
    smallest node that can be reached.

    Every round hooks each label to its smallest neighbour, follows the hooks
    twice, and keeps only the links that still lead from label to label, so
    the links shrink from round to round.  Lineage is cut by tables in the
    checkpoint folder; nothing is collected."""
    edges = written(links.select("a", "b").where("a <> b").distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))

    def moved(df: DataFrame, col: str, hook: DataFrame) -> DataFrame:
        step = hook.select(F.col("a").alias("k"), F.col("to").alias("v"))
        return df.join(step, F.col(col) == F.col("k"), "left").withColumn(col, F.coalesce("v", col)).drop("k", "v")

    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        for _ in range(2):
            hook = moved(hook, "to", hook)
        hook = written(hook)
        labels = written(moved(labels, "label", hook))
        edges = written(moved(moved(edges, "a", hook), "b", hook).where("a <> b").distinct())
    return labels
