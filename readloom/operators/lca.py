"""Last common ancestors of reads in a taxonomy, and abundances rolled up its tree.

A path is an array of names from "root" over the ranks to the reference. The tree is never a graph: an ancestor is an
element of a path, so sums over descendants are sums over exploded paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import half_even, ratio
from .tree import TreeIndex, tree_index

ROOT = "root"


def paths_from_lineages(lineages: DataFrame, ranks: list[str]) -> DataFrame:
    """reference, path. lineages: reference, lineage (map of rank to name); ranks from broad to narrow. References that
    lack a rank go."""
    names = [F.col("lineage")[r] for r in ranks]
    path = F.array(F.lit(ROOT), *names, F.col("reference"))
    return lineages.select("reference", path.alias("path")).filter(~F.array_contains(F.transform("path", lambda x: x.isNull()), True))


def edges(paths: DataFrame) -> DataFrame:
    """Distinct edges source, target of the paths, without loops."""
    pairs = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("source"), F.slice("path", F.lit(2), F.size("path") - 1).alias("target"))
    return paths.select(F.explode(pairs).alias("e")).select("e.source", "e.target").filter("source <> target").distinct()


def read_nodes(alignments: DataFrame, index: TreeIndex) -> DataFrame:
    """read, n_paths, node: the lowest node above all references of a read.

    What is exchanged for a read are numbers: how many leaves it has, the first and the last. Their ancestor is looked up
    once for each pair of leaves that occurs.
    """
    found = alignments.select(F.col("query_name").alias("read"), "reference").join(index.leaves.select("reference", "leaf"), "reference").select("read", "leaf").distinct()
    ends = found.groupBy("read").agg(F.count(F.lit(1)).alias("n_paths"), F.min("leaf").alias("lo"), F.max("leaf").alias("hi"))
    return ends.join(index.common(ends.select("lo", "hi").distinct()), ["lo", "hi"]).select("read", "n_paths", "node")


def tangled_lca(alignments: DataFrame, paths: DataFrame, index: TreeIndex) -> DataFrame:
    """read, n_paths, path of the reads all of whose references have a name that stands at several nodes.

    Nodes are known by name, so what such paths share is the set of their names, in the order of the first path; only
    these reads need the paths themselves.
    """
    marked = alignments.select(F.col("query_name").alias("read"), "reference").distinct().join(index.leaves.select("reference", "tangled"), "reference")
    caught = marked.groupBy("read").agg(F.min("tangled").alias("all")).filter("all").select("read")
    hits = marked.select("read", "reference").join(caught, "read", "left_semi").join(paths, "reference")
    grouped = hits.groupBy("read").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    shared = F.aggregate(F.slice("paths", F.lit(2), F.greatest(F.size("paths"), F.lit(1))), F.col("paths")[0], F.array_intersect)
    return grouped.select("read", F.size("paths").cast("bigint").alias("n_paths"), shared.alias("path"))


def read_lca(alignments: DataFrame, paths: DataFrame, index: TreeIndex | None = None) -> DataFrame:
    """read, n_paths, path: the names that all paths of a read share, in the order of its first path."""
    index = index or tree_index(paths)
    plain = read_nodes(alignments, index).join(index.nodes.select("node", "path"), "node").select("read", "n_paths", "path")
    if not index.tangled:
        return plain
    knots = tangled_lca(alignments, paths, index)
    return plain.join(knots, "read", "left_anti").unionByName(knots)


def lca_counts(alignments: DataFrame, paths: DataFrame, rank_index: int) -> DataFrame:
    """kind, path, reads of the reads that are unique or have a deep enough ancestor: path_counts(classify(read_lca)),
    but counted by node, so that a path is joined to a count and not to a read."""
    index = tree_index(paths)
    if index.tangled:
        return path_counts(classify(read_lca(alignments, paths, index), rank_index))
    counts = read_nodes(alignments, index).groupBy("node", F.least("n_paths", F.lit(2)).alias("n_paths")).agg(F.count(F.lit(1)).alias("reads"))
    return classify(counts.join(index.nodes.select("node", "path"), "node"), rank_index).filter("kind <> 'discarded'").select("kind", "path", "reads")


def classify(lcas: DataFrame, rank_index: int) -> DataFrame:
    """kind: unique (one path), lca (deep enough) or discarded."""
    kind = F.when(F.size("path") <= rank_index + 1, "discarded").when(F.col("n_paths") == 1, "unique").otherwise("lca")
    return lcas.withColumn("kind", kind)


def path_counts(classified: DataFrame) -> DataFrame:
    return classified.filter("kind <> 'discarded'").groupBy("kind", "path").agg(F.count(F.lit(1)).alias("reads"))


def unique_weights(counts: DataFrame, lengths: DataFrame, scale: float, stats: DataFrame | None = None) -> DataFrame:
    """path, weight, norm_weight of the paths with unique reads.

    With stats (reference, n_reads, n_reads_tad, coverage_mean_trunc_len) a known reference weighs n_reads_tad if that
    is less than its reads and these are at most n_reads, and nothing otherwise.
    """
    leaf = F.element_at("path", -1)
    x = counts.filter("kind = 'unique'").select("path", F.col("reads").alias("weight"), leaf.alias("reference"))
    x = x.join(lengths.select("reference", "reference_length"), "reference", "left")
    x = x.withColumn("norm_weight", half_even(ratio(F.col("weight"), F.col("reference_length")) * scale))
    if stats is not None:
        usable = stats.filter("n_reads_tad > 0").select("reference", F.col("n_reads").alias("s_reads"), F.col("n_reads_tad").alias("s_tad"), F.col("coverage_mean_trunc_len").alias("s_len"))
        x = x.join(usable, "reference", "left")
        known = F.col("s_tad").isNotNull()
        inside = (F.col("weight") <= F.col("s_reads")) & (F.col("weight") > F.col("s_tad"))
        norm = F.when(inside, half_even(ratio(F.col("s_tad"), F.col("s_len")) * scale)).otherwise(0)
        x = x.withColumn("norm_weight", F.when(known, norm).otherwise(F.col("norm_weight"))).withColumn("weight", F.when(known, F.when(inside, F.col("s_tad")).otherwise(0)).otherwise(F.col("weight")))
    return x.select("path", "reference", F.col("weight").cast("bigint").alias("weight"), F.col("norm_weight").cast("bigint").alias("norm_weight"))


def roll_up(weights: DataFrame) -> DataFrame:
    """node, prefix (its path), n_reads, abundance: sums over all paths below a node. A path's own end is left out: the
    weight lies on the edge into it."""
    above = weights.select(F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("i", "node"), "path", "weight", "norm_weight")
    return above.groupBy("node").agg(F.min(F.slice("path", F.lit(1), F.col("i") + 1)).alias("prefix"), F.sum("weight").alias("n_reads"), F.sum("norm_weight").alias("abundance"))


def continuations(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, reference, likelihood: of each LCA node (column node) the references below with their path likelihood.

    The likelihood of a path is the product over its edges of the weight on the edge and the weight gathered at its
    upper end.
    """
    cumulative = roll_up(weights).select("node", F.col("n_reads").alias("cum"))
    # A path carries the gathered weight of each of its nodes; sums are per distinct path, so the explosion is bounded
    # by the taxonomy and not by the reads.
    places = weights.select("reference", "path", "weight", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("i", "node"))
    factors = places.join(cumulative, "node").groupBy("reference", "path", "weight").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "cum"))), lambda s: s["cum"].cast("double")).alias("f"))
    last = F.size("f")
    below = factors.select("reference", "weight", "f", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("d", "node"))
    below = below.join(nodes.select("node").distinct(), "node", "left_semi")
    likelihood = F.aggregate(F.slice("f", F.col("d") + 1, last - F.col("d") - 1), F.lit(1.0), lambda a, b: a * b) * (F.element_at("f", -1) + F.col("weight"))
    return below.select("node", "reference", likelihood.alias("likelihood"), (last - F.col("d")).alias("steps"))


def best_continuation(found: DataFrame) -> DataFrame:
    """The most likely reference of each node; ties go to the longer path, then to the first name."""
    best = F.min(F.struct((-F.col("likelihood")).alias("l"), (-F.col("steps")).alias("s"), F.col("reference")))
    return found.groupBy("node").agg(best.alias("b")).select("node", F.col("b.reference").alias("reference"), (-F.col("b.l")).alias("likelihood"))


def top_continuations(found: DataFrame, n: int = 10) -> DataFrame:
    """The n most likely references of each node."""
    from pyspark.sql import Window

    order = Window.partitionBy("node").orderBy(F.desc("likelihood"), F.desc("steps"), "reference")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("steps")


def lca_weights(counts: DataFrame, weights: DataFrame, lengths: DataFrame, rank_index: int, scale: float) -> DataFrame:
    """path, weight, norm_weight of the LCA nodes, normalised by the length of the most likely reference below (or not
    at all where there is none)."""
    ends = counts.filter("kind = 'lca'").withColumn("node", F.element_at("path", -1))
    # The paths of a node agree in a tree; one of them is taken where names repeat.
    nodes = ends.groupBy("node").agg(F.min("path").alias("path"), F.sum("reads").alias("weight")).filter(F.size("path") > rank_index + 1)
    best = best_continuation(continuations(weights, nodes)).join(lengths.select("reference", "reference_length"), "reference", "left")
    x = nodes.join(best, "node", "left")
    norm = F.when(F.col("reference").isNull(), F.col("weight")).otherwise(half_even(F.lit(scale) * F.col("weight") / F.col("reference_length")))
    return x.select("path", F.col("weight").cast("bigint").alias("weight"), norm.cast("bigint").alias("norm_weight"))


def summarise(weights: DataFrame, lca: DataFrame) -> DataFrame:
    """name, n_reads, abundance, tax_path of every node with reads below, by path."""
    both = weights.select("path", "weight", "norm_weight").unionByName(lca)
    return roll_up(both).filter("n_reads > 0").select(F.col("node").alias("name"), "n_reads", "abundance", F.array_join("prefix", ";").alias("tax_path"))
