"""The registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bridge
from .bridge import SQL_PATHS, SQL_SUPPLIERS, sql_alignments
from .config import FilterConfig, ReassignConfig
from .functions import scalar as S
from .operators import align, coverage, em, inequality, lca, refilter, refstats
from .plans import pipelines
from .schema import REF_STATS
from .session import cut, scratch_folder
from .sources import bam, taxonomy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PARTS = sql_alignments()
SUPPLIERS = sql_alignments("l_suppkey")
RANK_INDEX = 1  # of region and nation: an LCA has to reach the nation


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.filter_by_ani(bridge.alignments(spark, sf_dir), 90.0)


# -- reads ------------------------------------------------------------------------------------------------------------


@_query(f"""WITH {PARTS}
SELECT reference, count(DISTINCT query_name) AS n_reads, count(*) AS n_alns, round(avg(len), 6) AS read_length_mean, round(avg(ani), 6) AS read_ani_mean,
  cast(round_even(count(DISTINCT query_name) / 2600.0 * 1000000, 0) AS bigint) AS tax_abund_read
FROM aln WHERE ani >= 90 GROUP BY reference HAVING count(DISTINCT query_name) >= 3""")
def min_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _kept(spark, sf_dir).groupBy("reference").agg(F.countDistinct("query_name").alias("n_reads"), F.count(F.lit(1)).alias("n_alns"), F.avg("inferred_read_length").alias("read_length_mean"), F.avg("ani").alias("read_ani_mean"))
    sized = per.join(bridge.part_references(spark, sf_dir), "reference")
    out = sized.withColumn("tax_abund_read", S.half_even(S.ratio(F.col("n_reads"), F.col("reference_length")) * 1e6)).filter("n_reads >= 3")
    return _rounded(out.select("reference", "n_reads", "n_alns", "read_length_mean", "read_ani_mean", "tax_abund_read"))


@_query(f"WITH {PARTS} SELECT query_name, reference, nm, round(ani, 6) AS ani FROM aln WHERE ani >= 90")
def aln_ani_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_kept(spark, sf_dir).select("query_name", "reference", "nm", "ani"))


@_query(f"WITH {PARTS} SELECT reference, count(*) AS n_mapped FROM aln GROUP BY reference HAVING count(*) >= 25")
def index_stats_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequent = align.keep_frequent_references(bridge.alignments(spark, sf_dir), 25)
    return align.index_stats(frequent)


LENGTHS_SQL = "given AS (SELECT cast(s_suppkey AS varchar) AS reference, cast(500 + s_suppkey AS bigint) AS length FROM supplier WHERE s_suppkey % 3 <> 0)"


def _given_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return bridge.table(spark, sf_dir, "supplier").filter(key % 3 != 0).select(key.cast("string").alias("reference"), (key + 500).cast("bigint").alias("length"))


@_query(f"WITH {SQL_SUPPLIERS}, {LENGTHS_SQL} SELECT r.reference, r.reference_length AS bam_reference_length, coalesce(g.length, r.reference_length) AS reference_length FROM refs r LEFT JOIN given g USING (reference)")
def ref_lengths_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = bridge.supplier_references(spark, sf_dir).select("reference", "bam_reference_length")
    return align.with_lengths(refs, _given_lengths(spark, sf_dir), check=False)


@_query(f"WITH {SQL_SUPPLIERS}, {LENGTHS_SQL} SELECT r.reference FROM refs r ANTI JOIN given g USING (reference)")
def ref_lengths_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.missing_lengths(bridge.supplier_references(spark, sf_dir), _given_lengths(spark, sf_dir))


SCORES_SQL = f"""{SUPPLIERS}, raw AS (
  SELECT query_name AS query, reference, len, (len - nm) + 2 * nm - coalesce(xo, 0) * 5 - coalesce(xg, 0) * 2 AS s FROM aln WHERE ani >= 90 AND len >= 30),
scores AS (SELECT query, reference, (s - min(s) OVER (PARTITION BY reference) + 1) / cast(len AS double) AS score FROM raw)"""
BEST_SQL = f"{SCORES_SQL}, best AS (SELECT query, reference, max(score) AS score FROM scores GROUP BY query, reference)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.normalised_scores(bridge.alignments(spark, sf_dir, "l_suppkey"))


@_query(f"WITH {SCORES_SQL} SELECT query, reference, round(score, 9) AS score FROM scores")
def aln_score_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir), 9)


@_query(f"WITH {BEST_SQL} SELECT query, reference, round(score, 9) AS score FROM best")
def aln_best_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(align.best_per_pair(_scores(spark, sf_dir)), 9)


@_query(f"""WITH {PARTS}, kept AS (SELECT *, as_score IS NULL AS bare FROM aln WHERE ani >= 90),
modes AS (SELECT reference, len FROM (SELECT reference, len, row_number() OVER (PARTITION BY reference ORDER BY count(*) DESC, len) AS rn FROM kept GROUP BY reference, len) WHERE rn = 1)
SELECT k.reference, count(DISTINCT query_name) AS n_reads, count(*) AS n_alns, round(avg(k.len), 6) AS read_length_mean, round(stddev_samp(k.len), 6) AS read_length_std,
  min(k.len) AS read_length_min, max(k.len) AS read_length_max, cast(median(k.len) AS double) AS read_length_median, any_value(m.len) AS read_length_mode,
  round(avg(k.len), 6) AS read_aligned_length,
  CASE WHEN bool_or(bare) THEN NULL ELSE round(avg(as_score), 6) END AS read_aln_score,
  CASE WHEN bool_or(mapping_quality = 255) THEN NULL ELSE round(avg(mapping_quality), 6) END AS mapping_quality,
  CASE WHEN bool_or(bare) THEN NULL ELSE round(avg(nm), 6) END AS edit_distances,
  CASE WHEN bool_or(bare) THEN NULL ELSE round(avg(ani), 6) END AS read_ani_mean,
  CASE WHEN bool_or(bare) THEN NULL ELSE round(stddev_samp(ani), 6) END AS read_ani_std,
  CASE WHEN bool_or(bare) THEN NULL ELSE round(median(ani), 6) END AS read_ani_median
FROM kept k JOIN modes m USING (reference) GROUP BY k.reference""")
def ref_read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(refstats.read_stats(_kept(spark, sf_dir)).drop("gc_content"))


@_query(f"WITH {PARTS} SELECT query_name AS read, count(*) AS count FROM aln WHERE ani >= 90 GROUP BY query_name")
def read_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.read_hits(_kept(spark, sf_dir))


@_query(f"""WITH {PARTS}, c AS (SELECT reference, len, count(*) AS n FROM aln WHERE ani >= 90 GROUP BY reference, len),
f AS (SELECT reference, len, round(n / sum(n) OVER (PARTITION BY reference), 6) AS freq FROM c)
SELECT reference, string_agg(cast(len AS varchar), ',' ORDER BY len) AS lengths, count(*) AS n_lengths, round(sum(freq), 4) AS total FROM f GROUP BY reference""")
def read_length_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = align.read_length_frequencies(_kept(spark, sf_dir))
    total = F.aggregate(F.transform("freq", lambda f: F.round(f, 6)), F.lit(0.0), lambda a, b: a + b)
    return x.select("reference", F.array_join(F.col("length").cast("array<string>"), ",").alias("lengths"), F.size("length").cast("bigint").alias("n_lengths"), F.round(total, 4).alias("total"))


@_query("""SELECT source, sum(length(text) - length(translate(text, 'GC', ''))) ::bigint AS gc, sum(length(text))::bigint AS bases,
  round(sum(length(text) - length(translate(text, 'GC', ''))) / sum(length(text)) * 100, 6) AS gc_content FROM documents GROUP BY source""")
def gc_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bridge.table(spark, sf_dir, "documents")
    x = docs.groupBy("source").agg(F.sum(S.gc_count(F.col("text"))).alias("gc"), F.sum(F.length("text")).alias("bases"))
    return _rounded(x.withColumn("gc_content", S.ratio(F.col("gc"), F.col("bases")) * 100))


# -- coverage ---------------------------------------------------------------------------------------------------------

SEGMENTS_SQL = f"""{PARTS}, kept AS (SELECT reference, reference_start AS s, reference_end AS e FROM aln WHERE ani >= 90),
ends AS (SELECT reference, s AS pos, 1 AS d FROM kept UNION ALL SELECT reference, e, -1 FROM kept UNION ALL SELECT DISTINCT reference, 0, 0 FROM kept UNION ALL SELECT DISTINCT reference, 2600, 0 FROM kept),
net AS (SELECT reference, pos, sum(d) AS d FROM ends GROUP BY reference, pos),
swept AS (SELECT reference, pos AS a, lead(pos) OVER w AS b, sum(d) OVER w AS depth FROM net WINDOW w AS (PARTITION BY reference ORDER BY pos)),
raw AS (SELECT reference, a, b, cast(depth AS bigint) AS depth FROM swept WHERE b > a),
segs AS (SELECT reference, greatest(a, 0) AS a, least(b, 2600) AS b, depth, least(b, 2600) - greatest(a, 0) AS n FROM raw WHERE least(b, 2600) > greatest(a, 0))"""


def _segments(spark: SparkSession, sf_dir: str, clipped: bool = True) -> DataFrame:
    refs = bridge.part_references(spark, sf_dir)
    segs = coverage.segments(_kept(spark, sf_dir), refs)
    return coverage.clip(segs, refs) if clipped else segs


@_query(f"WITH {SEGMENTS_SQL} SELECT reference, a AS seg_start, b AS seg_end, depth FROM segs")
def coverage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@_query(f"""WITH {PARTS}, iv AS (SELECT reference, reference_start AS s, reference_end AS e, max(reference_end) OVER (PARTITION BY reference ORDER BY reference_start, reference_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM aln WHERE ani >= 90),
num AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY reference ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM iv)
SELECT reference, min(s) AS "start", max(e) AS "end" FROM num GROUP BY reference, island""")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.islands(_segments(spark, sf_dir, clipped=False))


@_query(f"""WITH {SEGMENTS_SQL} SELECT reference, cast(sum(n) FILTER (depth > 0) AS bigint) AS bases_covered, round(sum(depth * n) / 2600.0, 6) AS coverage_mean,
  round(sum(depth * n) / sum(n) FILTER (depth > 0), 6) AS coverage_covered_mean, round(sum(n) FILTER (depth > 0) / 2600.0, 6) AS breadth,
  round(1 - exp(-sum(depth * n) / 2600.0), 6) AS exp_breadth,
  round(least(1, (sum(n) FILTER (depth > 0) / 2600.0) / (1 - exp(-sum(depth * n) / 2600.0))), 6) AS breadth_exp_ratio,
  round((sum(depth * depth * n) - cast(sum(depth * n) AS double) * sum(depth * n) / sum(n) FILTER (depth > 0)) / (sum(n) FILTER (depth > 0) - 1) / (sum(depth * n) / 2600.0), 6) AS d_i
FROM segs GROUP BY reference""")
def coverage_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = coverage.depth_stats(coverage.depth_histogram(_segments(spark, sf_dir)))
    mean, breadth = F.col("depth_sum") / 2600, F.col("bases_covered") / 2600
    expected = 1 - F.exp(-mean)
    return _rounded(x.select("reference", "bases_covered", mean.alias("coverage_mean"), S.ratio(F.col("depth_sum"), F.col("bases_covered")).alias("coverage_covered_mean"), breadth.alias("breadth"), expected.alias("exp_breadth"), F.least(breadth / expected, F.lit(1.0)).alias("breadth_exp_ratio"), S.ratio(F.col("cov_var"), mean).alias("d_i")))


TAD_PART = """pos AS (SELECT reference, depth, unnest(range(n)) AS k FROM segs),
q AS (SELECT reference, quantile_cont(depth, 0.1) AS lo, quantile_cont(depth, 0.9) AS hi FROM pos GROUP BY reference),
tad AS (SELECT s.reference, sum(depth * n) FILTER (depth BETWEEN lo AND hi) AS t, sum(n) FILTER (depth BETWEEN lo AND hi) AS m FROM segs s JOIN q USING (reference) GROUP BY s.reference)"""
TAD_SQL = f"{SEGMENTS_SQL}, {TAD_PART}"


@_query(f"WITH {TAD_SQL} SELECT reference, CASE WHEN t > 0 THEN round(t / m, 6) ELSE 0.0 END AS coverage_mean_trunc, CASE WHEN t > 0 THEN cast(m AS bigint) ELSE 0 END AS coverage_mean_trunc_len FROM tad")
def coverage_tad(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = coverage.depth_stats(coverage.depth_histogram(_segments(spark, sf_dir)))
    return _rounded(x.select("reference", "coverage_mean_trunc", "coverage_mean_trunc_len"))


@_query(f"""WITH {SEGMENTS_SQL}, lv AS (SELECT reference, round_even(sum(depth * n) / sum(n), 0) AS c FROM segs GROUP BY reference),
low AS (SELECT s.reference, any_value(c) AS c, sum(n) AS total, sum(n) FILTER (depth <= c) AS m, sum(depth * n) FILTER (depth <= c) AS t FROM segs s JOIN lv USING (reference) GROUP BY s.reference)
SELECT reference, round(CASE WHEN m IS NULL THEN 1.0 WHEN c <= 0 THEN 0.0 ELSE 1 - (m - t / c) / total END, 6) AS cov_evenness FROM low""")
def coverage_evenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(coverage.depth_stats(coverage.depth_histogram(_segments(spark, sf_dir))).select("reference", "cov_evenness"))


HIST_PART = """cov AS (SELECT reference, unnest(range(a, b)) AS x FROM segs WHERE depth > 0),
st AS (SELECT reference, count(*) AS n, max(x) - min(x) AS spread, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM cov GROUP BY reference),
wd AS (SELECT reference, n, 2 * iqr / pow(n, 1.0 / 3) AS fd, spread / (log2(n) + 1) AS st FROM st),
nb AS (SELECT reference, n, CASE WHEN (CASE WHEN fd > 0 THEN least(fd, st) ELSE st END) > 0 THEN cast(ceil(2600.0 / (CASE WHEN fd > 0 THEN least(fd, st) ELSE st END)) AS bigint) ELSE 1 END AS nb FROM wd),
hist AS (SELECT c.reference, c.x * nb // 2600 AS bin, count(*) AS c, any_value(nb) AS nb, any_value(n) AS n FROM cov c JOIN nb USING (reference) GROUP BY c.reference, c.x * nb // 2600)"""
HIST_SQL = f"{SEGMENTS_SQL}, {HIST_PART}"


def _histogram(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = bridge.part_references(spark, sf_dir)
    # Written once: bins and histogram read them four times.
    isles = cut(coverage.clip_islands(coverage.sized_islands(_segments(spark, sf_dir, clipped=False)), refs))
    bins = coverage.bin_counts(isles, refs)
    return coverage.position_histogram(isles, bins), bins


@_query(f"WITH {HIST_SQL} SELECT reference, cast(bin AS bigint) AS bin, c FROM hist")
def position_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)[0]


GINI_PART = """allbins AS (SELECT reference, nb, n, unnest(range(nb)) AS bin FROM (SELECT DISTINCT reference, nb, n FROM hist)),
filled AS (SELECT a.reference, a.nb, a.n, coalesce(h.c, 0) AS c FROM allbins a LEFT JOIN hist h ON a.reference = h.reference AND a.bin = h.bin),
cum AS (SELECT reference, nb, n, c, sum(c) OVER (PARTITION BY reference ORDER BY c, rowid_ ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, row_number() OVER () AS rowid_ FROM filled)),
g AS (SELECT reference, any_value(nb) AS nb, any_value(n) AS n, -sum(CASE WHEN c > 0 THEN c / n * ln(c / n) ELSE 0 END) AS h, 1 - 2 * ((sum(run) / any_value(n) - 0.5) / any_value(nb)) AS gini FROM cum GROUP BY reference),
k AS (SELECT *, n // nb AS q, n % nb AS r, nb - n % nb AS m FROM g),
lim AS (SELECT *, -(m * CASE WHEN q > 0 THEN (q / n) * ln(q / n) ELSE 0 END + r * ((q + 1) / n) * ln((q + 1) / n)) AS hmax,
  1 - 2 * (((q * m * (m + 1) / 2 + r * q * m + (q + 1) * r * (r + 1) / 2) / n - 0.5) / nb) AS gmin FROM k),
spread AS (SELECT reference, nb + 1 AS n_bins, h AS entropy, CASE WHEN n = 1 THEN 1 WHEN nb > 1 THEN h / hmax END AS norm_entropy, gini,
  CASE WHEN abs(1 - 1.0 / nb - gmin) < 1e-12 THEN 0 ELSE (gini - gmin) / (1 - 1.0 / nb - gmin) END AS norm_gini FROM lim)"""


@_query(f"""WITH {HIST_SQL}, {GINI_PART}
SELECT reference, n_bins, round(entropy, 6) AS entropy, round(norm_entropy, 6) AS norm_entropy, round(gini, 6) AS gini, round(norm_gini, 6) AS norm_gini FROM spread""")
def entropy_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(inequality.distribution_stats(*_histogram(spark, sf_dir)))


STATS_SQL = f"""{SEGMENTS_SQL}, {TAD_PART}, {HIST_PART}, {GINI_PART},
iv AS (SELECT reference, s, e, max(e) OVER (PARTITION BY reference ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM kept),
isl AS (SELECT reference, s, e, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY reference ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM iv),
mi AS (SELECT reference, max(n) AS longest, avg(n) AS mean FROM (SELECT reference, max(e) - min(s) AS n FROM isl GROUP BY reference, island) GROUP BY reference),
rd AS (SELECT reference, count(DISTINCT query_name) AS n_reads, count(*) AS n_alns, avg(len) AS l, stddev_samp(len) AS lsd, min(len) AS lmin, max(len) AS lmax, median(len)::double AS lmed,
  bool_or(as_score IS NULL) AS bare, avg(as_score) AS sc, CASE WHEN bool_or(mapping_quality = 255) THEN NULL ELSE avg(mapping_quality) END AS mq, avg(nm) AS ed, avg(ani) AS a, stddev_samp(ani) AS asd, median(ani) AS amed FROM aln WHERE ani >= 90 GROUP BY reference),
md AS (SELECT reference, len FROM (SELECT reference, len, row_number() OVER (PARTITION BY reference ORDER BY count(*) DESC, len) AS rn FROM aln WHERE ani >= 90 GROUP BY reference, len) WHERE rn = 1),
cs AS (SELECT reference, sum(depth * n)::double AS s1, sum(depth * depth * n)::double AS s2, (sum(n) FILTER (depth > 0))::bigint AS bc, round_even(sum(depth * n) / 2600.0, 0) AS lv FROM segs GROUP BY reference),
el AS (SELECT s.reference, CASE WHEN sum(n) FILTER (depth <= lv) IS NULL THEN 1.0 WHEN any_value(lv) <= 0 THEN 0.0 ELSE 1 - (sum(n) FILTER (depth <= lv) - sum(depth * n) FILTER (depth <= lv) / any_value(lv)) / sum(n) END AS e FROM segs s JOIN cs USING (reference) GROUP BY s.reference),
j1 AS (SELECT *, s1 / 2600 AS mean_, CASE WHEN bc > 1 THEN greatest(0, (s2 - s1 * s1 / bc) / (bc - 1)) END AS var, CASE WHEN t > 0 THEN t / m ELSE 0.0 END AS tr, CASE WHEN t > 0 THEN m::bigint ELSE 0 END AS trn
  FROM rd JOIN md USING (reference) JOIN cs USING (reference) JOIN el USING (reference) JOIN tad USING (reference) JOIN spread USING (reference) JOIN mi USING (reference)),
j2 AS (SELECT *, CASE WHEN trn > 0 AND tr > 0 THEN round_even(2600 * tr / l, 0)::bigint ELSE 0 END AS nt FROM j1),
stats AS (SELECT reference, n_reads, n_alns, l AS read_length_mean, lsd AS read_length_std, lmin AS read_length_min, lmax AS read_length_max, lmed AS read_length_median, len AS read_length_mode, NULL::double AS gc_content,
  l AS read_aligned_length, CASE WHEN NOT bare THEN sc END AS read_aln_score, mq AS mapping_quality, CASE WHEN NOT bare THEN ed END AS edit_distances, CASE WHEN NOT bare THEN a END AS read_ani_mean, CASE WHEN NOT bare THEN asd END AS read_ani_std,
  CASE WHEN NOT bare THEN amed END AS read_ani_median, bc AS bases_covered, longest AS max_covered_bases, mean AS mean_covered_bases, mean_ AS coverage_mean, tr AS coverage_mean_trunc, trn AS coverage_mean_trunc_len, s1 / bc AS coverage_covered_mean,
  2600::bigint AS reference_length, 2600::bigint AS bam_reference_length, bc / 2600.0 AS breadth, 1 - exp(-mean_) AS exp_breadth, least(1, (bc / 2600.0) / (1 - exp(-mean_))) AS breadth_exp_ratio, n_bins, bc * 1000 / 2600.0 AS site_density,
  entropy, norm_entropy, gini, norm_gini, sqrt(var) / mean_ AS c_v, var / mean_ AS d_i, e AS cov_evenness, round_even(n_reads / 2600.0 * 1000000, 0)::bigint AS tax_abund_read, round_even(n_alns / 2600.0 * 1000000, 0)::bigint AS tax_abund_aln,
  CASE WHEN trn > 0 AND tr > 0 THEN round_even(nt / trn::double * 1000000, 0)::bigint ELSE 0 END AS tax_abund_tad, nt AS n_reads_tad FROM j2)"""
_WHOLE = ("reference", "n_reads", "n_alns", "read_length_min", "read_length_max", "read_length_mode", "bases_covered", "max_covered_bases", "coverage_mean_trunc_len", "reference_length", "bam_reference_length", "n_bins", "tax_abund_read", "tax_abund_aln", "tax_abund_tad", "n_reads_tad")


@_query(f"WITH {STATS_SQL} SELECT {', '.join(c if c in _WHOLE else f'round({c}, 6) AS {c}' for c in REF_STATS)} FROM stats")
def reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(refstats.reference_stats(bridge.alignments(spark, sf_dir), bridge.part_references(spark, sf_dir)))


FILTERED_SQL = f"""{SEGMENTS_SQL}, r AS (SELECT reference, count(DISTINCT query_name) AS n_reads, avg(len) AS l, CASE WHEN bool_or(as_score IS NULL) THEN NULL ELSE avg(ani) END AS a FROM aln WHERE ani >= 90 GROUP BY reference),
c AS (SELECT reference, sum(depth * n) / 2600.0 AS mean, sum(n) FILTER (depth > 0) / 2600.0 AS breadth, sum(n) FILTER (depth > 0) AS bc, sum(depth * n) AS s1, sum(depth * depth * n) AS s2, round_even(sum(depth * n) / 2600.0, 0) AS lv FROM segs GROUP BY reference),
ev AS (SELECT s.reference, CASE WHEN sum(n) FILTER (depth <= lv) IS NULL THEN 1.0 WHEN any_value(lv) <= 0 THEN 0.0 ELSE 1 - (sum(n) FILTER (depth <= lv) - sum(depth * n) FILTER (depth <= lv) / any_value(lv)) / sum(n) END AS e FROM segs s JOIN c USING (reference) GROUP BY s.reference),
f AS (SELECT reference, n_reads, l, a, breadth, mean, least(1, breadth / (1 - exp(-mean))) AS ratio, sqrt((s2 - cast(s1 AS double) * s1 / bc) / (bc - 1)) / mean AS cv, e FROM r JOIN c USING (reference) JOIN ev USING (reference))"""
FIXED = {"min_breadth": 0.15, "min_expected_breadth_ratio": 0.5, "min_coverage_evenness": 0.05, "min_coeff_var": 2.5, "min_norm_entropy": None, "min_norm_gini": None, "min_read_count": 5}
CONDITIONS = "n_reads >= 5 AND l >= 30 AND a >= 90 AND ratio >= 0.5 AND breadth >= 0.15 AND {e} >= 0.05 AND cv <= 2.5"


def _passing(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    config = FilterConfig(**options)
    stats = refstats.reference_stats(bridge.alignments(spark, sf_dir), bridge.part_references(spark, sf_dir), config)
    if config.min_norm_entropy == "auto":
        stats = cut(stats)  # read twice: for the curve and for the verdict
    good = refilter.passing(stats, config, refilter.thresholds(stats, config))
    return _rounded(good.select("reference", "n_reads", "breadth", "coverage_mean"))


@_query(f"WITH {FILTERED_SQL} SELECT reference, n_reads, round(breadth, 6) AS breadth, round(mean, 6) AS coverage_mean FROM f WHERE {CONDITIONS.format(e='e')}")
def ref_filter_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir, **FIXED)


@_query(f"WITH {FILTERED_SQL} SELECT reference, n_reads, round(breadth, 6) AS breadth, round(mean, 6) AS coverage_mean FROM f WHERE {CONDITIONS.format(e='(CASE WHEN round_even(mean, 0) < 1 THEN 1 ELSE e END)')}")
def ref_filter_low_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir, **FIXED, include_low_detection=True)


_AUTO = FilterConfig(min_norm_entropy="auto", min_norm_gini="auto")
#: The curve has 11 points at most; the scan over them is the recursive part.
KNEE_SQL = f"""{STATS_SQL}, cv AS (SELECT round_even(norm_gini, 1) AS x, avg(norm_entropy) AS y FROM stats WHERE norm_gini IS NOT NULL GROUP BY 1),
pt AS (SELECT x, y, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS u, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS v FROM cv WHERE y IS NOT NULL),
ds AS (SELECT a.i, a.n, b.v - a.u AS d, 1.0 / (a.n - 1) AS step FROM pt a JOIN pt b ON b.i = a.n - 1 - a.i),
nx AS (SELECT i, n, step, d, lag(d) OVER (ORDER BY i) AS d0, lead(d) OVER (ORDER BY i) AS d2 FROM ds),
mk AS (SELECT *, i < n - 1 AND d0 <= d AND d >= d2 AND (d0 < d OR d2 < d) AS top, i < n - 1 AND d0 >= d AND d <= d2 AND d < d0 AS low FROM nx WHERE i > 0),
sc(i, cand, thr, found) AS (SELECT 0::bigint, NULL::bigint, NULL::double, NULL::bigint UNION ALL
  SELECT i, cand, CASE WHEN hit THEN NULL ELSE thr END, CASE WHEN hit THEN cand ELSE found END FROM (
    SELECT i, cand, thr, found, coalesce(i > cand AND d < thr, false) AS hit FROM (
      SELECT m.i, m.d, s.found, CASE WHEN top THEN m.i ELSE s.cand END AS cand, CASE WHEN top THEN d - step WHEN low AND s.thr IS NOT NULL THEN 0.0 WHEN low THEN NULL ELSE s.thr END AS thr FROM sc s JOIN mk m ON m.i = s.i + 1))),
lm AS (SELECT round(y, 3) AS e, round(x, 3) AS g FROM pt JOIN (SELECT found FROM sc ORDER BY i DESC LIMIT 1) f ON pt.i = pt.n - 1 - f.found)"""


@_query(f"""WITH RECURSIVE {KNEE_SQL} SELECT reference, n_reads, round(breadth, 6) AS breadth, round(coverage_mean, 6) AS coverage_mean FROM stats
WHERE n_reads >= {_AUTO.min_read_count} AND read_length_mean >= {_AUTO.min_read_length} AND read_ani_mean >= {_AUTO.min_avg_read_ani} AND breadth_exp_ratio >= {_AUTO.min_expected_breadth_ratio} AND breadth >= {_AUTO.min_breadth}
  AND cov_evenness >= {_AUTO.min_coverage_evenness} AND c_v <= {_AUTO.min_coeff_var if _AUTO.min_coeff_var < float('inf') else '1e308'} AND coverage_mean >= {_AUTO.min_coverage_mean}
  AND (NOT EXISTS (SELECT * FROM lm) OR (norm_entropy >= (SELECT e FROM lm) AND norm_gini <= (SELECT g FROM lm)))""")
def ref_filter_auto_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir, min_norm_entropy="auto", min_norm_gini="auto")


# -- reassignment -----------------------------------------------------------------------------------------------------

INIT_SQL = f"{BEST_SQL}, {SQL_SUPPLIERS}, e0 AS (SELECT query, reference, cast(reference_length AS double) AS slen, score / sum(score) OVER (PARTITION BY query) AS prob, count(*) OVER (PARTITION BY query) AS n_aln FROM best JOIN refs USING (reference))"


def _pass_sql(k: int) -> str:
    a, b = f"e{k - 1}", f"e{k}"
    return f"""w{k} AS (SELECT reference, sum(prob) / any_value(slen) AS w FROM {a} GROUP BY reference),
x{k} AS (SELECT query, reference, slen, prob * w / sum(prob * w) OVER (PARTITION BY query) AS prob, count(*) OVER (PARTITION BY query) AS n_aln FROM {a} JOIN w{k} USING (reference)),
{b} AS (SELECT query, reference, slen, prob, n_aln FROM (SELECT *, max(prob) OVER (PARTITION BY query) AS top FROM x{k}) WHERE n_aln = 1 OR prob >= top * 0.9)"""


def _em_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return em.initial(align.best_per_pair(_scores(spark, sf_dir)), bridge.supplier_references(spark, sf_dir))


@_query(f"WITH {INIT_SQL} SELECT query, reference, round(prob, 9) AS prob, n_aln FROM e0")
def em_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_em_start(spark, sf_dir).select("query", "reference", "prob", "n_aln"), 9)


@_query(f"WITH {INIT_SQL}, {_pass_sql(1)} SELECT query, reference, round(prob, 9) AS prob FROM e1")
def em_iter1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(em.unroll(_em_start(spark, sf_dir), 1, 0.9).select("query", "reference", "prob"), 9)


@_query(f"WITH {INIT_SQL}, {_pass_sql(1)}, {_pass_sql(2)}, {_pass_sql(3)} SELECT query, reference, round(prob, 9) AS prob FROM e3")
def em_iter3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(em.unroll(_em_start(spark, sf_dir), 3, 0.9).select("query", "reference", "prob"), 9)


def _resolve_sql(init: str) -> str:
    """All passes as one recursive query: each row set is the state after a pass, done after the last one."""
    return f"""{init}, em AS (SELECT 0 AS pass, false AS done, query, reference, slen, prob, 0 AS iter, n_aln FROM e0 UNION ALL
  SELECT pass, multi = 0 OR removed = 0 OR pass >= 25, query, reference, slen, prob, iter, n_aln FROM (
    SELECT *, count(*) FILTER (n_aln > 1) OVER () AS multi, count(*) FILTER (NOT stays) OVER () AS removed FROM (
      SELECT *, n_aln = 1 OR near AS stays FROM (
        SELECT pass, query, reference, slen, prob, n_aln, near, CASE WHEN n_aln > 1 AND near THEN pass ELSE iter END AS iter FROM (
          SELECT *, prob >= max(prob) OVER (PARTITION BY query) * 0.9 AS near FROM (
            SELECT pass + 1 AS pass, query, reference, slen, iter, prob * w / sum(prob * w) OVER (PARTITION BY query) AS prob, count(*) OVER (PARTITION BY query) AS n_aln FROM (
              SELECT *, sum(prob) OVER (PARTITION BY reference) / slen AS w FROM em WHERE NOT done)))))) WHERE stays),
last AS (SELECT * FROM em WHERE pass = (SELECT max(pass) FROM em))"""


@_query(f"WITH RECURSIVE {_resolve_sql(INIT_SQL)} SELECT query, reference, round(prob, 9) AS prob, iter, count(*) OVER (PARTITION BY query) AS n_aln FROM last")
def em_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(em.resolve(_em_start(spark, sf_dir)).select("query", "reference", "prob", "iter", "n_aln"), 9)


@_query(f"""WITH RECURSIVE {_resolve_sql(INIT_SQL)}, sized AS (SELECT pass, query, count(*) AS n FROM em GROUP BY pass, query),
per AS (SELECT pass, sum(n) AS alignments, coalesce(sum(n) FILTER (n > 1), 0) AS shared, count(*) FILTER (n = 1) AS alone FROM sized GROUP BY pass)
SELECT pass, alignments::bigint AS alignments, (CASE WHEN pass = 0 THEN shared ELSE lag(shared) OVER w END)::bigint AS multi,
  (CASE WHEN pass = 0 THEN 0 ELSE lag(alignments) OVER w - alignments END)::bigint AS removed, (alone - coalesce(lag(alone) OVER w, 0))::bigint AS settled FROM per WINDOW w AS (ORDER BY pass)""")
def em_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return em.resolve_passes(_em_start(spark, sf_dir)).tallies


_FREQUENT = ReassignConfig().min_read_count
SURVIVE_SQL = _resolve_sql(INIT_SQL.replace("FROM aln WHERE ani >= 90", f"FROM aln SEMI JOIN (SELECT reference FROM aln GROUP BY reference HAVING count(*) >= {_FREQUENT}) f USING (reference) WHERE ani >= 90"))


@_query(f"""WITH RECURSIVE {SURVIVE_SQL}, pairs AS (SELECT query, reference FROM last SEMI JOIN (SELECT reference FROM last GROUP BY reference HAVING count(*) >= {_FREQUENT}) f USING (reference))
SELECT query_name, aln.reference, reference_start, reference_end, nm FROM aln SEMI JOIN pairs p ON aln.query_name = p.query AND aln.reference = p.reference""")
def em_survivor_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipelines.reassign(bridge.alignments(spark, sf_dir, "l_suppkey"), bridge.supplier_references(spark, sf_dir).select("reference", "bam_reference_length"), ReassignConfig())
    return out.alignments.select("query_name", "reference", "reference_start", "reference_end", "nm")


# -- files of alignments ----------------------------------------------------------------------------------------------

#: Days before the first one that a start is counted from; a file has no places below 0.
SHIFT = 2000


def _bam_file(spark: SparkSession, sf_dir: str) -> str:
    """All order lines as a folder of alignment files in order of place, each with its index."""
    key = bridge.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("reference"))
    names = sorted(r[0] for r in key.collect())  # a header's worth of names
    alns = bridge.alignments(spark, sf_dir, "l_suppkey").withColumn("reference_start", F.col("reference_start") + SHIFT)
    # The header's order is that of the names. Tasks that write encode the plain columns.
    ordered = alns.select(*bam.PLAIN).orderBy("reference", "reference_start")
    bam.register(spark)
    path = f"{scratch_folder(spark, 'bam')}/lines"
    ordered.write.format("bam").mode("overwrite").option("lengths", json.dumps([[n, 1 << 20] for n in names])).option("order", "coordinate").option("layout", "files").option("level", 1).save(path)
    return path


@_query(f"""WITH {SUPPLIERS} SELECT query_name, reference, reference_start + {SHIFT} AS reference_start, reference_end + {SHIFT} AS reference_end,
  CASE WHEN mapping_quality % 10 = 0 THEN '-' ELSE '+' END AS strand, mapping_quality, len AS query_alignment_length, nm, as_score, xo, xg, len || 'M' AS cigar FROM aln""")
def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = spark.read.format("bam").option("raw", "false").load(_bam_file(spark, sf_dir))  # encoded records are not asked for
    return back.select("query_name", "reference", "reference_start", "reference_end", S.strand().alias("strand"), "mapping_quality", "query_alignment_length", "nm", "as_score", "xo", "xg", "cigar")


#: Covered bases as the sum of merged intervals.
CLI_SQL = f"""WITH {SUPPLIERS}, often AS (SELECT reference FROM aln GROUP BY reference HAVING count(*) >= 3),
kept AS (SELECT * FROM aln SEMI JOIN often USING (reference) WHERE ani >= 90),
iv AS (SELECT reference, reference_start AS s, reference_end AS e, max(reference_end) OVER (PARTITION BY reference ORDER BY reference_start, reference_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM kept),
num AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY reference ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM iv),
cov AS (SELECT reference, sum(n)::bigint AS bases_covered, max(n)::bigint AS max_covered_bases FROM (SELECT reference, max(e) - min(s) AS n FROM num GROUP BY reference, island) GROUP BY reference)
SELECT reference, count(DISTINCT query_name) AS n_reads, count(*) AS n_alns, any_value(bases_covered) AS bases_covered, any_value(max_covered_bases) AS max_covered_bases,
  1048576::bigint AS reference_length, round(sum(len) / 1048576.0, 6) AS coverage_mean FROM kept JOIN cov USING (reference) GROUP BY reference"""


@_query(CLI_SQL)
def cli_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line over a folder of alignment files, and its table of statistics read back."""
    from . import cli

    table = f"{scratch_folder(spark, 'cli')}/stats.tsv.gz"
    assert cli.main(["filter", "--bam", _bam_file(spark, sf_dir), "--stats", table, "--low-memory"]) == 0
    x = spark.read.option("header", True).option("sep", "\t").csv(table)
    whole = ("n_reads", "n_alns", "bases_covered", "max_covered_bases", "reference_length")
    return x.select("reference", *[F.col(c).cast("bigint").alias(c) for c in whole], F.round(F.col("coverage_mean").cast("double"), 6).alias("coverage_mean"))


@_query(f"WITH {SUPPLIERS} SELECT reference, count(*) AS n_mapped, 0::bigint AS n_unmapped FROM aln GROUP BY reference")
def bam_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bam.index_counts(spark, _bam_file(spark, sf_dir))


# -- last common ancestors --------------------------------------------------------------------------------------------

HITS_SQL = f"""{SUPPLIERS}, {SQL_PATHS}, {SQL_SUPPLIERS}, hits AS (SELECT DISTINCT query_name AS read, p.* FROM aln JOIN paths p USING (reference)),
per AS (SELECT read, count(*) AS n_paths, count(DISTINCT n1) AS d1, count(DISTINCT n2) AS d2, count(DISTINCT n3) AS d3, min(n1) AS n1, min(n2) AS n2, min(n3) AS n3 FROM hits GROUP BY read),
lca AS (SELECT read, n_paths, CASE WHEN d3 = 1 THEN 4 WHEN d2 = 1 THEN 3 WHEN d1 = 1 THEN 2 ELSE 1 END AS depth, n1, n2, n3 FROM per),
cnt AS (SELECT CASE WHEN n_paths = 1 THEN 'unique' ELSE 'lca' END AS kind, depth, CASE WHEN depth >= 2 THEN n1 END AS n1, CASE WHEN depth >= 3 THEN n2 END AS n2, CASE WHEN depth >= 4 THEN n3 END AS n3, count(*) AS reads FROM lca WHERE depth > 2 GROUP BY ALL),
uw AS (SELECT c.n1, c.n2, c.n3, p.reference, c.reads AS w, cast(round_even(c.reads / cast(r.reference_length AS double) * 1000000, 0) AS bigint) AS nw FROM cnt c JOIN paths p ON c.n3 = p.n3 JOIN refs r USING (reference) WHERE kind = 'unique')"""
UP_SQL = """SELECT 'root' AS node, 'root' AS tax_path, sum(w) AS n_reads, sum(nw) AS abundance FROM {x} UNION ALL
SELECT n1, 'root;' || n1, sum(w), sum(nw) FROM {x} GROUP BY n1 UNION ALL
SELECT n2, 'root;' || n1 || ';' || n2, sum(w), sum(nw) FROM {x} WHERE n3 IS NOT NULL GROUP BY n1, n2"""
LIKELY_SQL = f"""{HITS_SQL}, up AS ({UP_SQL.format(x='uw')}),
like_ AS (SELECT u.n2 AS node, u.reference, cast(c.n_reads + u.w AS double) AS likelihood FROM uw u JOIN up c ON c.node = u.n2 WHERE u.n2 IN (SELECT n2 FROM cnt WHERE kind = 'lca')),
best AS (SELECT node, reference, likelihood FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY likelihood DESC, reference) AS rn FROM like_) WHERE rn = 1)"""
SUMMARY_SQL = f"""{LIKELY_SQL}, lw AS (SELECT n1, n2, CAST(NULL AS varchar) AS n3, reads AS w, CASE WHEN b.reference IS NULL THEN reads ELSE cast(round_even(1000000.0 * reads / r.reference_length, 0) AS bigint) END AS nw
  FROM cnt c LEFT JOIN best b ON b.node = c.n2 LEFT JOIN refs r ON r.reference = b.reference WHERE kind = 'lca'),
both_ AS (SELECT n1, n2, n3, w, nw FROM uw UNION ALL SELECT n1, n2, n3, w, nw FROM lw)"""


def _lca_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bridge.alignments(spark, sf_dir, "l_suppkey"), bridge.supplier_paths(spark, sf_dir)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lca.lca_counts(*_lca_inputs(spark, sf_dir), RANK_INDEX)


def _weights(spark: SparkSession, sf_dir: str, counts: DataFrame) -> DataFrame:
    return lca.unique_weights(counts, bridge.supplier_references(spark, sf_dir), 1e6)


@_query(f"WITH {SQL_PATHS} SELECT reference, n0 || ';' || n1 || ';' || n2 || ';' || n3 AS tax_path FROM paths")
def tax_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.supplier_paths(spark, sf_dir).select("reference", F.array_join("path", ";").alias("tax_path"))


DUMP_SQL = f"""{bridge.SQL_DUMP}, up AS (SELECT s_suppkey + 10000 AS taxid, s_suppkey + 10000 AS at, 0 AS depth FROM supplier UNION ALL SELECT u.taxid, n.parent, depth + 1 FROM up u JOIN nodes n ON n.taxid = u.at WHERE n.parent <> n.taxid),
rk AS (SELECT u.taxid, rank, min(depth) AS depth, arg_max(name, depth) AS name FROM up u JOIN nodes n ON n.taxid = u.at JOIN names m ON m.taxid = u.at WHERE rank <> 'no rank' GROUP BY u.taxid, rank)"""


@_query(f"WITH RECURSIVE {DUMP_SQL} SELECT taxid::bigint AS taxid, string_agg(rank || '=' || name, ';' ORDER BY depth) AS lineage FROM rk GROUP BY taxid")
def tax_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    accessions, nodes, names = bridge.taxonomy_dump(spark, sf_dir)
    x = taxonomy.lineages(accessions.select("taxid"), nodes, names)
    return x.select("taxid", F.array_join(F.transform(F.map_entries("lineage"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("lineage"))


def _dump_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The taxonomy as text: nodes and names between TAB | TAB, with a synonym for each name, and an accession table."""
    accessions, nodes, names = bridge.taxonomy_dump(spark, sf_dir)
    folder = scratch_folder(spark, "dump")
    line = lambda *fields: F.concat(F.concat_ws("\t|\t", *[F.col(f).cast("string") if isinstance(f, str) else f for f in fields]), F.lit("\t|")).alias("value")
    nodes.select(line("taxid", "parent", "rank")).write.text(f"{folder}/nodes")
    synonyms = names.select("taxid", F.concat(F.lit("other "), "name").alias("name"), F.lit("synonym").alias("class"))
    both = names.withColumn("class", F.lit("scientific name")).unionByName(synonyms)
    both.select(line("taxid", "name", F.lit(""), "class")).write.text(f"{folder}/names")
    accessions.select(F.col("reference").alias("accession"), F.col("reference").alias("accession.version"), "taxid", F.lit(0).alias("gi")).write.option("sep", "\t").option("header", True).csv(f"{folder}/accessions")
    return {k: f"{folder}/{k}" for k in ("nodes", "names", "accessions")}


@_query(f"WITH RECURSIVE {DUMP_SQL} SELECT (taxid - 10000)::varchar AS reference, string_agg(rank || '=' || name, ';' ORDER BY depth) AS lineage FROM rk GROUP BY taxid")
def tax_lineage_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _dump_files(spark, sf_dir)
    accessions, nodes, names = taxonomy.read_accessions(spark, files["accessions"]), taxonomy.read_nodes(spark, files["nodes"]), taxonomy.read_names(spark, files["names"])
    x = taxonomy.reference_lineages(bridge.ordered_suppliers(spark, sf_dir), accessions, nodes, names)
    return x.select("reference", F.array_join(F.transform(F.map_entries("lineage"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("lineage"))


@_query(f"""WITH RECURSIVE {DUMP_SQL} SELECT (taxid - 10000)::varchar AS reference, 'root;' || max(name) FILTER (rank = 'superkingdom') || ';' || max(name) FILTER (rank = 'clade') || ';' || max(name) FILTER (rank = 'genus') || ';'
  || max(name) FILTER (rank = 'species') || ';' || (taxid - 10000) AS tax_path FROM rk GROUP BY taxid""")
def tax_paths_from_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(taxonomy.reference_lineages(bridge.ordered_suppliers(spark, sf_dir), *bridge.taxonomy_dump(spark, sf_dir)))
    return lca.paths_from_lineages(found, taxonomy.rank_template(found)).select("reference", F.array_join("path", ";").alias("tax_path"))


@_query(f"WITH {SQL_PATHS} SELECT DISTINCT n0 AS source, n1 AS target FROM paths UNION SELECT n1, n2 FROM paths UNION SELECT n2, n3 FROM paths")
def tax_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lca.edges(bridge.supplier_paths(spark, sf_dir))


@_query(f"WITH {HITS_SQL} SELECT read, n_paths, 'root' || CASE WHEN depth >= 2 THEN ';' || n1 ELSE '' END || CASE WHEN depth >= 3 THEN ';' || n2 ELSE '' END || CASE WHEN depth >= 4 THEN ';' || n3 ELSE '' END AS tax_path FROM lca")
def read_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lca.read_lca(*_lca_inputs(spark, sf_dir))
    return x.select("read", F.col("n_paths").cast("bigint").alias("n_paths"), F.array_join("path", ";").alias("tax_path"))


@_query(f"WITH {HITS_SQL}, up AS ({UP_SQL.format(x='uw')}) SELECT node AS name, cast(n_reads AS bigint) AS n_reads, cast(abundance AS bigint) AS abundance, tax_path FROM up")
def tax_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lca.roll_up(_weights(spark, sf_dir, _counts(spark, sf_dir)))
    return x.select(F.col("node").alias("name"), "n_reads", "abundance", F.array_join("prefix", ";").alias("tax_path"))


@_query(f"WITH {LIKELY_SQL} SELECT node, reference, likelihood FROM best")
def lca_best_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    nodes = counts.filter("kind = 'lca'").select(F.element_at("path", -1).alias("node"))
    return lca.best_continuation(lca.continuations(_weights(spark, sf_dir, counts), nodes))


@_query(f"WITH {LIKELY_SQL} SELECT node, reference, likelihood, cast(place AS integer) AS place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY likelihood DESC, reference) AS place FROM like_) WHERE place <= 10")
def lca_top_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    nodes = counts.filter("kind = 'lca'").select(F.element_at("path", -1).alias("node"))
    return lca.top_continuations(lca.continuations(_weights(spark, sf_dir, counts), nodes))


@_query(f"WITH {SUMMARY_SQL} SELECT n1, n2, w AS weight, nw AS norm_weight FROM lw")
def lca_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    lengths = bridge.supplier_references(spark, sf_dir)
    x = lca.lca_weights(counts, _weights(spark, sf_dir, counts), lengths, RANK_INDEX, 1e6)
    return x.select(F.col("path")[1].alias("n1"), F.col("path")[2].alias("n2"), "weight", "norm_weight")


@_query(f"WITH {SUMMARY_SQL}, up2 AS ({UP_SQL.format(x='both_')}) SELECT node AS name, cast(n_reads AS bigint) AS n_reads, cast(abundance AS bigint) AS abundance, tax_path FROM up2 WHERE n_reads > 0")
def lca_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    alns, paths = _lca_inputs(spark, sf_dir)
    return pipelines.lca_from_paths(alns, paths, bridge.supplier_references(spark, sf_dir), RANK_INDEX)


TAD_STATS_SQL = """ts AS (SELECT cast(s_suppkey AS varchar) AS reference, 12 AS s_reads, cast(4 + s_suppkey % 5 AS bigint) AS s_tad, 900.0 AS s_len FROM supplier WHERE s_suppkey % 2 = 0),
tw AS (SELECT u.n1, u.n2, u.n3, CASE WHEN t.s_tad IS NULL THEN u.w WHEN u.w <= s_reads AND u.w > s_tad THEN s_tad ELSE 0 END AS w,
  CASE WHEN t.s_tad IS NULL THEN u.nw WHEN u.w <= s_reads AND u.w > s_tad THEN cast(round_even(s_tad / s_len * 1000000, 0) AS bigint) ELSE 0 END AS nw FROM uw u LEFT JOIN ts t USING (reference))"""


@_query(f"WITH {HITS_SQL}, {TAD_STATS_SQL}, up AS ({UP_SQL.format(x='tw')}) SELECT node AS name, cast(n_reads AS bigint) AS n_reads, cast(abundance AS bigint) AS abundance, tax_path FROM up WHERE n_reads > 0")
def lca_summary_tad(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    stats = bridge.table(spark, sf_dir, "supplier").filter(key % 2 == 0).select(key.cast("string").alias("reference"), F.lit(12).alias("n_reads"), (key % 5 + 4).cast("bigint").alias("n_reads_tad"), F.lit(900.0).alias("coverage_mean_trunc_len"))
    weights = lca.unique_weights(_counts(spark, sf_dir), bridge.supplier_references(spark, sf_dir), 1e6, stats)
    x = lca.roll_up(weights).filter("n_reads > 0")
    return x.select(F.col("node").alias("name"), "n_reads", "abundance", F.array_join("prefix", ";").alias("tax_path"))

