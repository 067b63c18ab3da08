"""Depth of coverage as segments, and all measures that follow from it. No position is ever a row.

A reference is swept in tiles, each with the depth at which it starts, so a reference that holds most of the
alignments, or a very long one, spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..session import cut

TILE = 1 << 18


def segments(alignments: DataFrame, references: DataFrame, tile: int = TILE) -> DataFrame:
    """reference, tile, seg_start, seg_end, depth, edge, bam_reference_length: stretches of equal depth from 0 to the end
    of the reference (or of the last alignment past it). A stretch may be cut in equal parts where tiles meet; edge: it
    reaches such a place. The length is NULL for references that the table lacks.

    Alignments are cut where tiles meet, so every tile is swept by itself, once, and no depth has to be carried into it.
    Ends at one place are added up before they are exchanged, so a popular place is one row of each task.
    """
    size = F.lit(tile).cast("bigint")
    ends = alignments.select("reference", F.greatest(F.col("reference_start"), F.lit(0)).cast("bigint").alias("s"), F.greatest(F.col("reference_end"), F.lit(0)).cast("bigint").alias("e")).filter("e > s")
    # Tiles have to begin and end somewhere even where no alignment does: marks are alignments of weight 0.
    length = F.col("bam_reference_length").cast("bigint")
    extent = ends.groupBy("reference").agg(F.max("e").alias("last")).join(references.select("reference", "bam_reference_length"), "reference")
    whole = F.struct(F.lit(0).cast("bigint").alias("s"), F.greatest("last", length).alias("e"))
    marks = extent.select("reference", F.explode(F.array(whole, F.struct(length.alias("s"), length.alias("e")))).alias("x"), length.alias("length"))
    weighed = ends.withColumns({"w": F.lit(1), "length": F.lit(None).cast("bigint")}).unionByName(marks.select("reference", "x.s", "x.e", F.lit(0).alias("w"), "length"))
    first = F.expr(f"s div {tile}")
    cut_up = weighed.withColumn("tile", F.explode(F.sequence(first, F.greatest(first, F.expr(f"(e - 1) div {tile}")))))
    a, b = F.greatest(F.col("s"), F.col("tile") * size), F.least(F.col("e"), (F.col("tile") + 1) * size)
    steps = cut_up.select("reference", "tile", "length", F.explode(F.array(F.struct(a.alias("pos"), F.col("w").alias("d")), F.struct(b.alias("pos"), (-F.col("w")).alias("d")))).alias("x"))
    deltas = steps.select("reference", "tile", "length", "x.*").groupBy("reference", "tile", "pos").agg(F.sum("d").alias("delta"), F.max("length").alias("length"))
    within = Window.partitionBy("reference", "tile").orderBy("pos")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    swept = deltas.select(
        "reference", "tile", F.col("pos").alias("seg_start"), F.lead("pos").over(within).alias("seg_end"), F.sum("delta").over(upto).alias("depth"),
        F.max("length").over(upto).alias("bam_reference_length"),  # a mark is at every tile's beginning
    )
    edge = (F.col("seg_start") % tile == 0) | (F.col("seg_end") % tile == 0)
    return swept.filter("seg_end > seg_start").select("reference", "tile", "seg_start", "seg_end", "depth", edge.alias("edge"), "bam_reference_length")


def clip(segs: DataFrame, references: DataFrame, trim: int = 0) -> DataFrame:
    """Segments within the reference less ``trim`` bases at both ends (no trim where it would leave nothing)."""
    length = F.col("bam_reference_length")
    t = F.when((F.lit(trim) > length) | (F.lit(2 * trim) > length), 0).otherwise(trim)
    # Segments of a sweep know the length already.
    sized = segs if "bam_reference_length" in segs.columns else segs.join(references.select("reference", "bam_reference_length"), "reference")
    inside = sized.withColumn("t", t)
    inside = inside.withColumn("a", F.greatest("seg_start", "t")).withColumn("b", F.least("seg_end", length - F.col("t"))).filter(length.isNotNull() & F.expr("b > a"))
    return inside.select("reference", F.col("a").alias("seg_start"), F.col("b").alias("seg_end"), "depth")


def depth_histogram(segs: DataFrame) -> DataFrame:
    """reference, depth, n: how many positions have which depth."""
    return segs.groupBy("reference", "depth").agg(F.sum(F.col("seg_end") - F.col("seg_start")).alias("n"))


def islands(segs: DataFrame) -> DataFrame:
    """reference, start, end of the maximal covered stretches: the alignments' intervals merged, book-ended ones too."""
    return sized_islands(segs).select("reference", "start", "end")


def sized_islands(segs: DataFrame) -> DataFrame:
    """Islands with the bam_reference_length of their reference.

    Covered stretches that touch are joined within a tile, where the sweep has them together already. Only stretches
    that reach an edge of their tile, two for each tile at most, are then ordered by reference; the others stay with
    their tile, where they touch nothing. So the sweep is read once.
    """
    length = F.max("bam_reference_length").alias("bam_reference_length")
    parts = _joined(segs.filter("depth > 0"), ["reference", "tile"], "seg_start", "seg_end", F.bool_or("edge").alias("edge"), length)
    placed = parts.withColumn("place", F.when(F.col("edge"), -1).otherwise(F.col("tile")))
    return _joined(placed, ["reference", "place"], "start", "end", length).select("reference", "start", "end", "bam_reference_length")


def clip_islands(isles: DataFrame, references: DataFrame, trim: int = 0) -> DataFrame:
    """The parts of islands within the reference less ``trim`` bases at both ends, as ``clip`` cuts segments."""
    known = [c for c in isles.columns if c == "bam_reference_length"]
    clipped = clip(isles.select("reference", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), F.lit(1).alias("depth"), *known), references, trim)
    return clipped.select("reference", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))


def _joined(rows: DataFrame, keys: list[str], start: str, end: str, *more: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(start)
    opens = F.coalesce(F.col(start) > F.lag(end).over(order), F.lit(True)).cast("int")
    numbered = rows.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), *more)
    return out.drop("island")


def merged_interval_stats(isles: DataFrame) -> DataFrame:
    n = F.col("end") - F.col("start")
    return isles.groupBy("reference").agg(F.max(n).alias("max_covered_bases"), F.avg(n).alias("mean_covered_bases"))


def depth_stats(hist: DataFrame, trim_min: int = 10, trim_max: int = 90) -> DataFrame:
    """Per reference from its depth histogram: length, sums, covered spread, truncated mean depth and evenness."""
    hist = cut(hist)  # read twice, the sweep behind it once
    d, n = F.col("depth").cast("double"), F.col("n")
    total = hist.groupBy("reference").agg(
        F.sum("n").alias("vector_length"),
        F.sum(d * n).alias("depth_sum"),
        F.sum(F.when(d > 0, n).otherwise(0)).alias("bases_covered"),
        F.sum(d * d * n).alias("depth_square_sum"),
        F.percentile("depth", F.array(F.lit(trim_min / 100), F.lit(trim_max / 100)), F.col("n")).alias("bounds"),
    )
    total = total.withColumn("level", F.rint(F.col("depth_sum") / F.col("vector_length")))
    joined = hist.join(total.select("reference", "bounds", "level"), "reference")
    kept = (d >= F.col("bounds")[0]) & (d <= F.col("bounds")[1])
    low = d <= F.col("level")
    parts = joined.groupBy("reference").agg(
        F.sum(F.when(kept, d * n)).alias("tad_sum"), F.sum(F.when(kept, n)).alias("tad_n"), F.sum(F.when(low, n)).alias("low_n"), F.sum(F.when(low, d * n)).alias("low_sum")
    )
    out = total.join(parts, "reference")
    covered = F.col("bases_covered")
    variance = ratio(F.col("depth_square_sum") - ratio(F.col("depth_sum") * F.col("depth_sum"), covered), covered - 1)
    some = F.coalesce(F.col("tad_sum"), F.lit(0.0)) > 0
    evenness = F.when(F.col("low_n").isNull(), 1.0).when(F.col("level") <= 0, 0.0).otherwise(1 - (F.col("low_n") - F.col("low_sum") / F.nullif(F.col("level"), F.lit(0.0))) / F.col("vector_length"))
    return out.select(
        "reference", "vector_length", "depth_sum", "bases_covered",
        F.when(variance < 0, 0.0).otherwise(variance).alias("cov_var"),
        F.when(some, F.col("tad_sum") / F.col("tad_n")).otherwise(0.0).alias("coverage_mean_trunc"),
        F.when(some, F.col("tad_n")).otherwise(0).cast("bigint").alias("coverage_mean_trunc_len"),
        evenness.alias("cov_evenness"),
    )


def covered_ranks(isles: DataFrame, tile: int = TILE) -> DataFrame:
    """Islands with the ranks [lo, hi) of their positions among all covered ones, and their number n_obs.

    Running lengths are counted within tiles (by an island's start); a second running count goes over the tiles' sums.
    """
    placed = isles.withColumn("tile", F.floor(F.col("start") / tile))
    n = F.col("end") - F.col("start")
    sums = placed.groupBy("reference", "tile").agg(F.sum(n).alias("s"))
    before = Window.partitionBy("reference").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("reference", "tile", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("carry"), F.sum("s").over(Window.partitionBy("reference")).alias("n_obs"))
    order = Window.partitionBy("reference", "tile").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("run", F.sum(n).over(order)).join(carried, ["reference", "tile"]).withColumn("hi", F.col("carry") + F.col("run"))
    return ranked.withColumn("lo", F.col("hi") - n).drop("tile", "run", "carry")


def _at_rank(k: Column) -> Column:
    """The covered position of rank k."""
    return F.max(F.when((F.col("lo") <= k) & (k < F.col("hi")), F.col("start") + k - F.col("lo")))


def bin_counts(isles: DataFrame, references: DataFrame, rule: str = "classic") -> DataFrame:
    """reference, nb: bins of the covered positions over [0, length).

    The width is the least of Freedman-Diaconis' and Sturges' (the latter alone where the quartiles meet); rule
    ``integer`` takes 1 at least. A width of 0 makes one bin.
    """
    ranked = covered_ranks(isles)
    h1, h3 = (F.col("n_obs") - 1) * 0.25, (F.col("n_obs") - 1) * 0.75
    stats = ranked.groupBy("reference").agg(
        F.max("n_obs").alias("n_obs"), (F.max("end") - 1 - F.min("start")).alias("spread"),
        *[_at_rank(f(h)).alias(name) for h, a, b in ((h1, "q1a", "q1b"), (h3, "q3a", "q3b")) for f, name in ((F.floor, a), (F.ceil, b))],
    )
    part = lambda a, b, q: F.col(a) + (F.col(b) - F.col(a)) * ((F.col("n_obs") - 1) * q - F.floor((F.col("n_obs") - 1) * q))
    iqr = part("q3a", "q3b", 0.75) - part("q1a", "q1b", 0.25)
    fd = 2 * iqr / F.pow(F.col("n_obs").cast("double"), F.lit(1 / 3))
    sturges = F.col("spread") / (F.log2(F.col("n_obs").cast("double")) + 1)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    if rule == "integer":
        width = F.when(width > 0, F.greatest(width, F.lit(1.0))).otherwise(width)
    sized = stats.join(references.select("reference", "bam_reference_length"), "reference")
    nb = F.when(width > 0, F.ceil(F.try_divide(F.col("bam_reference_length").cast("double"), width))).otherwise(1)
    return sized.select("reference", "bam_reference_length", "n_obs", nb.cast("bigint").alias("nb"))


def position_histogram(isles: DataFrame, bins: DataFrame) -> DataFrame:
    """reference, bin, c: covered positions in each bin that has any. Bin i holds [ceil(i L / nb), ceil((i + 1) L / nb))."""
    joined = isles.join(bins.select("reference", "bam_reference_length", "nb"), "reference")
    bin_of = lambda pos: F.expr(f"least(({pos} * nb) div bam_reference_length, nb - 1)")
    spread = joined.withColumn("bin", F.explode(F.sequence(bin_of("start"), bin_of("(end - 1)"))))
    edge = lambda i: F.expr(f"({i} * bam_reference_length + nb - 1) div nb")
    c = F.least("end", edge("(bin + 1)")) - F.greatest("start", edge("bin"))
    return spread.withColumn("c", c).filter("c > 0").groupBy("reference", "bin").agg(F.sum("c").alias("c"))
