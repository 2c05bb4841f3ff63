"""Connected components of a graph given as an edge table, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage


def _to_smallest(edges: DataFrame, node: str, other: str, with_self: bool) -> DataFrame:
    """Smallest neighbour of every node (and the node itself)."""
    least = F.min(other)
    return edges.groupBy(node).agg((F.least(F.col(node), least) if with_self else least).alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that occurs in an edge; the component is its smallest node.

    Self-loops, repeated and null edges are ignored. Every round is a few aggregations and equi-joins; the edge table
    is written per round, so nothing grows with the number of rounds and lost executors cost one round at most.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, mark = cut_lineage(now), None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found["n"] == 0 or (found["n"], found["h"]) == mark:
            break
        mark = (found["n"], found["h"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_to_smallest(both, "u", "v", True), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _to_smallest(large, "u", "v", False)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
