"""Entropy and Gini coefficient of binned positions, from how often each count occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def distribution_stats(histogram: DataFrame, bins: DataFrame) -> DataFrame:
    """reference, n_bins (edges), entropy, norm_entropy, gini, norm_gini. Undefined values are NULL."""
    often = histogram.groupBy("reference", "c").agg(F.count(F.lit(1)).alias("m"))
    joined = often.join(bins.select("reference", "nb", "n_obs"), "reference")
    # Ascending counts; the empty bins come first. A bin of rank i (from 1) counts nb - i + 1 times in the Lorenz sum.
    upto = Window.partitionBy("reference").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.sum("m").over(Window.partitionBy("reference"))
    ranked = joined.withColumn("last", F.col("nb") - filled + F.sum("m").over(upto)).withColumn("first", F.col("last") - F.col("m") + 1)
    lorenz = F.col("c") * (F.col("m") * (F.col("nb") + 1) - (F.col("first") + F.col("last")) * F.col("m") / 2.0)
    c = F.col("c").cast("double")
    sums = ranked.groupBy("reference").agg(F.max("nb").alias("nb"), F.max("n_obs").alias("n"), F.sum(lorenz).alias("lorenz"), F.sum(F.col("m") * _xlogx(c)).alias("xlogx"))
    b, n = F.col("nb").cast("double"), F.col("n").cast("double")
    entropy = F.when(F.col("nb") == 1, 0.0).otherwise(F.ln(n) - F.col("xlogx") / n)
    q = F.floor(n / b).cast("double")
    r = n - q * b
    m = b - r
    most = -(m * _xlogx(q / n) + r * _xlogx((q + 1) / n))
    norm_entropy = F.when(F.col("n") == 1, 1.0).otherwise(F.when(F.col("nb") > 1, F.try_divide(entropy, most)))
    gini = 1 - 2 * ((F.col("lorenz") / n - 0.5) / b)
    even = q * m * (m + 1) / 2 + r * q * m + (q + 1) * r * (r + 1) / 2
    low = 1 - 2 * ((even / n - 0.5) / b)
    span = (1 - 1 / b) - low
    norm_gini = F.when(F.abs(span) < 1e-12, 0.0).otherwise(ratio(gini - low, span))
    return sums.select("reference", (F.col("nb") + 1).alias("n_bins"), entropy.alias("entropy"), norm_entropy.alias("norm_entropy"), gini.alias("gini"), norm_gini.alias("norm_gini"))
