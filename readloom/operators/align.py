"""Filters, lengths and scores of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ReassignConfig
from ..functions import scalar as S


class MissingReferences(ValueError):
    """References of the alignments that the table of lengths lacks."""


def filter_by_ani(alignments: DataFrame, min_read_ani: float) -> DataFrame:
    return alignments.withColumn("ani", S.read_ani()).filter(F.col("ani") >= min_read_ani)


def index_stats(alignments: DataFrame) -> DataFrame:
    """Mapped records of each reference, as an index counts them (before any filter)."""
    return alignments.filter(F.col("reference").isNotNull()).groupBy("reference").agg(F.count(F.lit(1)).alias("n_mapped"))


def keep_frequent_references(alignments: DataFrame, min_read_count: int, counts: DataFrame | None = None) -> DataFrame:
    """Alignments of the references with enough mapped records.

    counts: reference, n_mapped, n_unmapped of the placed records, if an index of the file tells them; the records are not
    read for that then, nor exchanged, as what an index names is no more than a header does.
    """
    if counts is None:
        frequent = index_stats(alignments).filter(F.col("n_mapped") >= min_read_count)
        return alignments.join(frequent.select("reference"), "reference", "left_semi")
    frequent = counts.filter(F.col("n_mapped") + F.col("n_unmapped") >= min_read_count)
    return alignments.join(F.broadcast(frequent.select("reference")), "reference", "left_semi")


def missing_lengths(references: DataFrame, lengths: DataFrame) -> DataFrame:
    return references.select("reference").join(lengths, "reference", "left_anti")


def with_lengths(references: DataFrame, lengths: DataFrame | None, check: bool = True) -> DataFrame:
    """references with reference_length: that of the table of lengths, or the header's without one."""
    if lengths is None:
        return references.withColumn("reference_length", F.col("bam_reference_length"))
    if check:
        missing = [r[0] for r in missing_lengths(references, lengths).limit(5).collect()]
        if missing:
            raise MissingReferences(f"no length for {', '.join(map(str, missing))}")
    known = lengths.select("reference", F.col("length").cast("bigint").alias("given_length")).dropDuplicates(["reference"])
    joined = references.join(known, "reference", "left")
    return joined.withColumn("reference_length", F.coalesce("given_length", "bam_reference_length")).drop("given_length")


def normalised_scores(alignments: DataFrame, config: ReassignConfig = ReassignConfig()) -> DataFrame:
    """query, reference and score of the alignments that pass the filters.

    Scores are shifted to begin at 1 within each reference and divided by the aligned length. The least score of a
    reference comes from an aggregate that is joined back, so no task holds a whole reference.
    """
    length = S.effective_length()
    kept = alignments.filter(
        (length >= config.min_read_length) & (length <= config.max_read_length) & (S.identity() >= config.min_read_ani)
    )
    score = S.alignment_score(config.match_reward, config.mismatch_penalty, config.gap_open_penalty, config.gap_extension_penalty)
    scored = kept.select("query_name", "reference", "query_alignment_length", score.alias("raw_score"))
    least = scored.groupBy("reference").agg(F.min("raw_score").alias("least_score"))
    shifted = (F.col("raw_score") - F.col("least_score") + 1).cast("double")
    return scored.join(least, "reference").select(F.col("query_name").alias("query"), "reference", (shifted / F.nullif(F.col("query_alignment_length"), F.lit(0))).alias("score"))


def best_per_pair(scores: DataFrame) -> DataFrame:
    """The best score of each query and reference."""
    return scores.groupBy("query", "reference").agg(F.max("score").alias("score"))


def read_hits(alignments: DataFrame) -> DataFrame:
    """Alignments of each read over all references."""
    return alignments.groupBy(F.col("query_name").alias("read")).agg(F.count(F.lit(1)).alias("count"))


def read_length_frequencies(alignments: DataFrame) -> DataFrame:
    """Of each reference: its read lengths in ascending order and their relative frequencies."""
    counts = alignments.groupBy("reference", F.col("inferred_read_length").alias("length")).count()
    share = F.col("count") / F.sum("count").over(Window.partitionBy("reference"))
    pairs = counts.withColumn("freq", share).groupBy("reference").agg(F.sort_array(F.collect_list(F.struct("length", "freq"))).alias("x"))
    return pairs.select("reference", F.col("x.length").alias("length"), F.col("x.freq").alias("freq"))
