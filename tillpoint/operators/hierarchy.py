"""Recursive hierarchy expansion (V9) as bounded iterative joins.

Equivalent to ``WITH RECURSIVE t AS (roots UNION ALL child JOIN t ...
WHERE t.depth < max_depth)``: level k+1 is the join of the node table with
level k.  Every level is a distributed join; nothing is collected.  The
loop stops at ``max_depth`` or when a level is empty.  Every few levels the
accumulated result is checkpointed to the session's checkpoint folder so
the lineage (and a lost executor's recomputation) stays short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_hierarchy(nodes: DataFrame, is_root: Column, id_col: str = "category_id",
                     parent_col: str = "parent_id", name_col: str = "name",
                     max_depth: int = 8, sep: str = " > ",
                     checkpoint_every: int = 4) -> DataFrame:
    n = nodes.select(id_col, name_col, parent_col)
    level = n.filter(is_root).select(
        id_col, name_col, parent_col, F.col(name_col).alias("path"),
        F.lit(0).alias("depth"))
    levels = [level]
    for depth in range(max_depth):
        parents = level.select(F.col(id_col).alias("__pid"), F.col("path").alias("__ppath"))
        level = n.join(parents, n[parent_col] == parents["__pid"]).select(
            id_col, name_col, parent_col,
            F.concat(F.col("__ppath"), F.lit(sep), F.col(name_col)).alias("path"),
            F.lit(depth + 1).alias("depth"))
        if (depth + 1) % checkpoint_every == 0:
            level = level.checkpoint(eager=True)
        else:
            level = level.persist()
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)
