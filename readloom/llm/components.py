"""Connected components of an edge table by alternating stars, without gathering any neighbourhood in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its least node.

    Each round hangs the larger neighbours of a node, then the smaller ones, under the least of them; the number of
    rounds grows with the logarithm of the size of a component. Only minima are aggregated, so a hub's edges are never
    together; joins meet one row per node on one side, so a hub can be split. Null ends and loops are left out.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = Scratch.table(now, "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        before, now = now, Scratch.table(small.filter("u > v").distinct(), "edges")
        Scratch.drop(before)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Has every node one lower neighbour, which has none itself?"""
    if edges.groupBy("u").count().filter("count > 1").limit(1).count():
        return False
    return not edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
