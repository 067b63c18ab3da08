"""Trees as tables: ancestors by pointer doubling, and an index of numbers that answers ancestor queries.

Nothing here walks level by level: the ancestors 2^k levels up are those of the ancestors 2^(k-1) levels up, so a tree of
depth 32 takes five rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A node's number is that of its first leaf times this, plus its depth.
DEPTHS = 256


class CycleError(ValueError):
    """A node is its own ancestor."""


def doubled(edges: DataFrame, most: int = 1000) -> list[DataFrame]:
    """node, up for the ancestors 1, 2, 4, 8 ... levels above each node, as long as any node has one.

    edges: node, up (null or missing at a root). A node with an ancestor more than ``most`` levels up is in a cycle.
    """
    tables = [cut(edges.filter("up is not null").select("node", "up"))]
    while not tables[-1].isEmpty():
        if 1 << (len(tables) - 1) > most:
            raise CycleError(f"a node has an ancestor more than {most} levels up: is there a cycle in the tree?")
        further = tables[-1].select(F.col("node").alias("up"), F.col("up").alias("up2"))
        tables.append(cut(tables[-1].join(further, "up").select("node", F.col("up2").alias("up"))))
    return tables[:-1]


def walks(starts: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """start, at, depth: every start (column start) with all nodes on its way up, itself at depth 0 included."""
    every = cut(starts.select("start", F.col("start").alias("at"), F.lit(0).alias("depth")).distinct())
    for k, table in enumerate(tables):
        higher = every.join(table, every["at"] == table["node"]).select("start", F.col("up").alias("at"), (F.col("depth") + (1 << k)).alias("depth"))
        every = every.unionByName(cut(higher))
    return every


@dataclass
class TreeIndex:
    """leaves: reference, leaf (in the order of the paths), tangled. nodes: node, high (last leaf below), path.
    jumps: for each 2^k, node, up and the last leaf below up. tangled: whether a name stands at more than one node."""

    leaves: DataFrame
    nodes: DataFrame
    jumps: list[DataFrame]
    tangled: bool

    def common(self, pairs: DataFrame) -> DataFrame:
        """lo, hi, node: the lowest node above both leaves of each pair (lo <= hi).

        The leaves below a node are neighbours in number, so a node above lo is above hi as well if its last leaf is not
        before hi. From the own node of lo the longest jumps come first that stay short of such a node.
        """
        own = self.leaves.select(F.col("leaf").alias("lo"), F.col("node"), F.col("high")).distinct()
        now = pairs.join(own, "lo")
        for k in range(len(self.jumps) - 1, -1, -1):
            jump = self.jumps[k].select("node", "up", "up_high")
            short = F.col("up").isNotNull() & (F.col("up_high") < F.col("hi"))
            now = now.join(jump, "node", "left").select("lo", "hi", F.when(short, F.col("up")).otherwise(F.col("node")).alias("node"), F.when(short, F.col("up_high")).otherwise(F.col("high")).alias("high"))
        if not self.jumps:
            return now.select("lo", "hi", "node")
        parent = self.jumps[0].select("node", "up")
        return now.join(parent, "node", "left").select("lo", "hi", F.when(F.col("high") < F.col("hi"), F.col("up")).otherwise(F.col("node")).alias("node"))


def tree_index(paths: DataFrame) -> TreeIndex:
    """The index of paths (reference, path: names from the root down to the reference)."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = paths.select("path", "reference").distinct().repartitionByRange(n, "path").sortWithinPartitions("path")
    # Numbers that grow over sorted range partitions are in the order of the paths; written down, they stay as they are.
    numbered = cut(ordered.withColumn("id", F.monotonically_increasing_id()))
    leaves = numbered.groupBy("path").agg(F.min("id").alias("leaf")).join(numbered.select("path", "reference"), "path")
    prefixes = numbered.select(F.col("id").alias("leaf"), F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda d: F.slice("path", F.lit(1), d))).alias("path"))
    nodes = prefixes.groupBy("path").agg(F.min("leaf").alias("low"), F.max("leaf").alias("high"))
    nodes = cut(nodes.select((F.col("low") * DEPTHS + F.size("path")).alias("node"), "high", "path", F.element_at("path", -1).alias("name")))
    twice = nodes.groupBy("name").count().filter("count > 1").select("name")
    deepest, tangled = nodes.select(F.max(F.size("path"))).first()[0] or 0, not twice.isEmpty()
    if deepest >= DEPTHS:
        raise ValueError(f"a path has {deepest} names; {DEPTHS - 1} are possible")
    above = nodes.select(F.col("node").alias("up"), F.col("path").alias("above"))
    cut_short = nodes.select("node", F.slice("path", F.lit(1), F.size("path") - 1).alias("above")).filter(F.size("above") > 0)
    tables = doubled(cut_short.join(above, "above").select("node", "up"), DEPTHS)
    jumps = [t.join(nodes.select(F.col("node").alias("up"), F.col("high").alias("up_high")), "up") for t in tables]
    leaves = leaves.join(nodes.select("path", "node", "high"), "path")
    if tangled:
        knots = leaves.select("reference", F.explode("path").alias("name")).join(twice, "name").select("reference").distinct().withColumn("tangled", F.lit(True))
        leaves = leaves.join(knots, "reference", "left").withColumn("tangled", F.coalesce("tangled", F.lit(False)))
    else:
        leaves = leaves.withColumn("tangled", F.lit(False))
    return TreeIndex(cut(leaves.select("reference", "leaf", "node", "high", "tangled")), nodes.select("node", "high", "path"), [cut(j) for j in jumps], tangled)
