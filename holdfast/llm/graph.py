"""Connected components of an edge table, by alternating large and small stars.

Every round moves edges towards the smallest id that a node sees; hubs are aggregated before they are
joined back, and the joins read written tables, so that a hub's edges are split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """Edges u - v as (u, v), u > v. Large: bigger neighbours of u go to the least of all; small: smaller ones do."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{name}-least")
    if large:
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = scratch.save(moved.filter("u > v").distinct(), name)
    scratch.drop(f"{name}-least")
    return out


def components(edges: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 60) -> DataFrame:
    """edges (a, b) -> node, component: the smallest id reachable, for nodes that are not their own component."""
    at = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{name}-0")
    for i in range(rounds):
        wide = _star(at, scratch, f"{name}-{i}-large", True)
        small = _star(wide, scratch, f"{name}-{i}-small", False)
        scratch.drop(f"{name}-{i}-large", f"{name}-{i - 1}-small" if i else f"{name}-0")
        n = small.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("d")).first()
        at = small
        if n["n"] == n["d"] and small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
