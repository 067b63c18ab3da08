"""The three pipelines: filter references, reassign reads, last common ancestors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ConfigError, FilterConfig, LcaConfig, ReassignConfig
from ..operators import align, coverage, em, lca, refilter, refstats
from ..session import cut
from ..sources import taxonomy


@dataclass
class Filtered:
    stats: DataFrame
    passing: DataFrame
    alignments: DataFrame
    thresholds: tuple[float, float] | None
    read_hits: DataFrame | None = None
    read_length_freqs: DataFrame | None = None


def by_place(alignments: DataFrame) -> DataFrame:
    """The records as a table in the shared folder, exchanged once: those of a reference and tile together, in order.

    Aggregates by reference or place then find their groups whole within a task, so what they exchange are results, and
    row groups of references that a join leaves out are skipped by their least and greatest name. A reference with most
    of the records is spread over its tiles.
    """
    tile = F.floor(F.col("reference_start") / coverage.TILE)
    return cut(alignments.withColumn("tile", tile).repartition("reference", "tile").sortWithinPartitions("reference", "tile", "reference_start").drop("tile"))


def filter_references(alignments: DataFrame, references: DataFrame, config: FilterConfig = FilterConfig(), lengths: DataFrame | None = None, stored: bool = False, counts: DataFrame | None = None) -> Filtered:
    """Statistics of all references with enough mapped records, those that pass, and their alignments.

    stored: the records of these references are written once (``by_place``), and every measure reads that table.
    counts: what an index says of the records of each reference (``bam.index_counts``).
    """
    sized = align.with_lengths(references, lengths)
    frequent = align.keep_frequent_references(alignments, config.min_read_count, counts)
    if stored:
        frequent = by_place(frequent)
    stats = cut(refstats.reference_stats(frequent, sized, config))
    limits = refilter.thresholds(stats, config)
    good = refilter.passing(stats, config, limits)
    kept = align.filter_by_ani((frequent if stored else alignments).join(good.select("reference"), "reference", "left_semi"), config.min_read_ani).drop("ani")
    usable = align.filter_by_ani(frequent, config.min_read_ani)
    hits = align.read_hits(usable) if config.read_hits_count else None
    freqs = align.read_length_frequencies(usable) if config.read_length_freqs else None
    return Filtered(stats, good, kept.select(alignments.columns), limits, hits, freqs)


@dataclass
class Reassigned:
    pairs: DataFrame
    alignments: DataFrame


def reassign(alignments: DataFrame, references: DataFrame, config: ReassignConfig = ReassignConfig(), lengths: DataFrame | None = None) -> Reassigned:
    """The pairs of query and reference that survive, and all their records."""
    sized = align.with_lengths(references, lengths)
    frequent = align.keep_frequent_references(alignments, config.min_read_count)
    scores = align.best_per_pair(align.normalised_scores(frequent, config))
    state = em.resolve(em.initial(scores, sized), config.iters, config.scale)
    pairs = em.frequent_survivors(state, config.min_read_count)
    return Reassigned(pairs, em.surviving_alignments(alignments, pairs))


def lca_summary(
    alignments: DataFrame, references: DataFrame, accessions: DataFrame, nodes: DataFrame, names: DataFrame,
    config: LcaConfig = LcaConfig(), lengths: DataFrame | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """taxid, name, rank, n_reads, abundance, tax_path of every node with reads below it."""
    sized = align.with_lengths(references, lengths)
    found = cut(taxonomy.reference_lineages(references, accessions, nodes, names, config.custom))
    ranks = taxonomy.rank_template(found)
    if ranks and config.rank not in ranks:
        raise ConfigError(f"rank {config.rank!r} is not among {', '.join(ranks)}")
    index = ranks.index(config.rank) if ranks else 0
    summary = lca_from_paths(alignments, lca.paths_from_lineages(found, ranks), sized, index, config.scale, stats)
    ids = names.groupBy("name").agg(F.min("taxid").alias("taxid")).join(nodes.select("taxid", "rank"), "taxid")
    return summary.join(ids, "name", "left").select("taxid", "name", "rank", "n_reads", "abundance", "tax_path")


def lca_from_paths(alignments: DataFrame, paths: DataFrame, lengths: DataFrame, rank_index: int, scale: float = 1e6, stats: DataFrame | None = None) -> DataFrame:
    """name, n_reads, abundance, tax_path. lengths: reference, reference_length."""
    counts = cut(lca.lca_counts(alignments, paths, rank_index))
    weights = lca.unique_weights(counts, lengths, scale, stats)
    return lca.summarise(weights, lca.lca_weights(counts, weights, lengths, rank_index, scale))
