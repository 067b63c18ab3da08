"""The statistics table: one row of 42 columns per reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FilterConfig
from ..functions import scalar as S
from ..schema import REF_STATS
from ..session import cut
from . import coverage, inequality


def read_stats(alignments: DataFrame) -> DataFrame:
    """Counts, lengths, scores and identities of the alignments (with ``ani``) of each reference.

    Distinct reads are counted on two columns apart. In one aggregate with the others, every record would be exchanged
    with the partial results of all of them; like this, tasks send one row for each reference they saw, and the pairs.
    """
    scored = F.col("as_score").isNotNull()
    length = F.col("inferred_read_length")
    score, nm, ani = (F.when(scored, F.col(c)).cast("double") for c in ("as_score", "nm", "ani"))
    mapq = F.when(F.col("mapping_quality") != 255, F.col("mapping_quality")).cast("double")
    complete = F.count(F.when(scored, 1)) == F.count(F.lit(1))
    pairs = alignments.select("reference", "query_name").distinct().groupBy("reference").agg(F.count("query_name").alias("n_reads"))
    measures = alignments.groupBy("reference").agg(
        F.count(F.lit(1)).alias("n_alns"),
        F.avg(length).alias("read_length_mean"),
        F.stddev_samp(length).alias("read_length_std"),
        F.min(length).alias("read_length_min"),
        F.max(length).alias("read_length_max"),
        F.median(length).alias("read_length_median"),
        F.mode(length, True).alias("read_length_mode"),
        (S.ratio(F.sum(S.gc_count(F.col("query_sequence"))), F.sum(length)) * 100).alias("gc_content"),
        F.avg("query_alignment_length").alias("read_aligned_length"),
        S.whole_mean(score).alias("read_aln_score"),
        S.whole_mean(mapq).alias("mapping_quality"),
        S.whole_mean(nm).alias("edit_distances"),
        S.whole_mean(ani).alias("read_ani_mean"),
        F.when(complete, F.stddev_samp(ani)).alias("read_ani_std"),
        F.when(complete, F.median(ani)).alias("read_ani_median"),
    )
    return measures.join(pairs, "reference")


def coverage_stats(alignments: DataFrame, references: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Depth, intervals, bins and inequality of each reference (bam_reference_length known) that has alignments."""
    # One sweep serves depth, intervals and bins; islands are read by four aggregates.
    raw = cut(coverage.segments(alignments, references))
    segs = coverage.clip(raw, references, config.trim_ends)
    depth = coverage.depth_stats(coverage.depth_histogram(segs), config.trim_min, config.trim_max)
    whole = cut(coverage.sized_islands(raw))
    merged = coverage.merged_interval_stats(whole)
    isles = coverage.clip_islands(whole, references, config.trim_ends)
    bins = coverage.bin_counts(isles, references, config.bin_rule)
    spread = inequality.distribution_stats(coverage.position_histogram(isles, bins), bins)
    return depth.join(merged, "reference", "left").join(spread, "reference", "left")


def reference_stats(alignments: DataFrame, references: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """The whole table. references: reference, bam_reference_length, reference_length. Filters alignments by identity."""
    kept = alignments.withColumn("ani", S.read_ani()).filter(F.col("ani") >= config.min_read_ani)
    reads = read_stats(kept)
    cover = coverage_stats(kept, references, config)
    x = reads.join(cover, "reference").join(references.select("reference", "bam_reference_length", "reference_length"), "reference")
    length = F.col("reference_length") - 2 * config.trim_ends
    x = x.withColumn("coverage_mean", S.ratio(F.col("depth_sum"), length)).withColumn("breadth", S.ratio(F.col("bases_covered"), length))
    x = x.withColumn("exp_breadth", 1 - F.exp(-F.col("coverage_mean")))
    has_tad = (F.col("coverage_mean_trunc_len") > 0) & (F.col("coverage_mean_trunc") > 0)
    x = x.withColumn("n_reads_tad", F.when(has_tad, S.half_even(F.col("reference_length") * F.col("coverage_mean_trunc") / F.col("read_length_mean"))).otherwise(0))
    per = lambda n, of: S.half_even(S.ratio(F.col(n), F.col(of)) * config.scale)
    x = x.withColumns({
        "breadth_exp_ratio": F.least(S.ratio(F.col("breadth"), F.col("exp_breadth")), F.lit(1.0)),
        "coverage_covered_mean": S.ratio(F.col("depth_sum"), F.col("bases_covered")),
        "c_v": S.ratio(F.sqrt("cov_var"), F.col("coverage_mean")),
        "d_i": S.ratio(F.col("cov_var"), F.col("coverage_mean")),
        "site_density": S.ratio(F.col("bases_covered") * 1000, F.col("bam_reference_length")),
        "tax_abund_aln": per("n_alns", "reference_length"),
        "tax_abund_read": per("n_reads", "reference_length"),
        "tax_abund_tad": F.when(has_tad, per("n_reads_tad", "coverage_mean_trunc_len")).otherwise(0),
    })
    return x.select(*REF_STATS)
