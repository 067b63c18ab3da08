"""Column expressions over alignments. Missing values are NULL throughout, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def read_ani() -> Column:
    """Identity in percent over the length that the CIGAR implies."""
    return (1 - ratio(F.col("nm"), F.col("inferred_query_length"))) * 100


def strand() -> Column:
    """+ or -, NULL where the orientation isn't known."""
    return F.when(F.col("is_reverse"), "-").when(~F.col("is_reverse"), "+")


def effective_length() -> Column:
    """Length of the stored sequence, or of the CIGAR where none is stored."""
    return F.coalesce(F.nullif(F.col("query_length"), F.lit(0)), F.col("inferred_query_length"))


def identity() -> Column:
    return (1 - ratio(F.col("nm"), effective_length())) * 100


def alignment_score(match: int = 1, mismatch: int = -2, gap_open: int = 5, gap_extend: int = 2) -> Column:
    """Rewards minus penalties; a negative mismatch penalty thus rewards mismatches."""
    gaps, extensions = F.coalesce(F.col("xo"), F.lit(0)), F.coalesce(F.col("xg"), F.lit(0))
    return (effective_length() - F.col("nm")) * match - F.col("nm") * mismatch - gaps * gap_open - extensions * gap_extend


def gc_count(sequence: Column) -> Column:
    """Upper-case G and C."""
    return F.length(sequence) - F.length(F.translate(sequence, "GC", ""))


def whole_mean(x: Column) -> Column:
    """Mean that is missing as soon as one value is."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def at_least(x: Column, least: float) -> Column:
    """x >= least; a missing or undefined x fails."""
    return F.coalesce(~F.isnan(x.cast("double")) & (x >= F.lit(float(least))), F.lit(False))


def at_most(x: Column, most: float) -> Column:
    return F.coalesce(~F.isnan(x.cast("double")) & (x <= F.lit(float(most))), F.lit(False))


def half_even(x: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.rint(x).cast("bigint")
