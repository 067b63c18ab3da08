"""Which references pass: fixed thresholds, or entropy and Gini thresholds at the knee of their curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FilterConfig
from ..functions.scalar import at_least, at_most
from .kneedle import knee

#: Of a table with one reference only, where no curve can be drawn.
SINGLE_GINI, SINGLE_ENTROPY = 0.5, 0.75


def knee_curve(stats: DataFrame) -> DataFrame:
    """gini (norm_gini to one decimal, ties to even), norm_entropy (mean): 11 rows at most."""
    known = stats.filter("norm_gini is not null")
    return known.groupBy(F.bround("norm_gini", 1).alias("gini")).agg(F.avg("norm_entropy").alias("norm_entropy"))


def thresholds(stats: DataFrame, config: FilterConfig) -> tuple[float, float] | None:
    """(least entropy, greatest Gini), or None where inequality is not used. "auto" for one decides both."""
    entropy, gini = config.min_norm_entropy, config.min_norm_gini
    if entropy is None or gini is None:
        return None
    if "auto" not in (entropy, gini):
        return float(entropy), float(gini)
    if stats.limit(2).count() < 2:
        return SINGLE_ENTROPY, SINGLE_GINI
    curve = sorted((r[0], r[1]) for r in knee_curve(stats).collect() if r[1] is not None)
    found = knee([c[0] for c in curve], [c[1] for c in curve])
    return None if found is None else (round(found[1], 3), round(found[0], 3))


def passing(stats: DataFrame, config: FilterConfig, inequality: tuple[float, float] | None) -> DataFrame:
    """Rows of stats that meet every condition; a value that is missing meets none."""
    evenness = F.col("cov_evenness")
    if config.include_low_detection:
        evenness = F.when(F.rint("coverage_mean") < 1, 1.0).otherwise(evenness)
    conditions = [
        at_least(F.col("n_reads"), config.min_read_count),
        at_least(F.col("read_length_mean"), config.min_read_length),
        at_most(F.col("read_length_mean"), config.max_read_length),
        at_least(F.col("read_ani_mean"), config.min_avg_read_ani),
        at_least(F.col("breadth_exp_ratio"), config.min_expected_breadth_ratio),
        at_least(F.col("breadth"), config.min_breadth),
        at_least(evenness, config.min_coverage_evenness),
        at_most(F.col("c_v"), config.min_coeff_var),
        at_least(F.col("coverage_mean"), config.min_coverage_mean),
    ]
    if inequality is not None:
        conditions += [at_least(F.col("norm_entropy"), inequality[0]), at_most(F.col("norm_gini"), inequality[1])]
    keep = conditions[0]
    for c in conditions[1:]:
        keep &= c
    return stats.filter(keep)
