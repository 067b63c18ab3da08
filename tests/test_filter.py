import numpy as np
import pytest
from fixtures import aln, dense, entropy, even, evenness, frame, gini, n_bins, norm_gini, refs, tad

from readloom.config import FilterConfig
from readloom.operators import align, coverage, refilter, refstats
from readloom.plans import pipelines
from readloom.schema import REF_STATS


@pytest.fixture(scope="module")
def random_case(spark):
    rng = np.random.default_rng(5)
    lengths = {f"r{i}": int(rng.integers(200, 3000)) for i in range(12)}
    rows, intervals = [], {}
    for name, length in lengths.items():
        for k in range(int(rng.integers(1, 60))):
            a = int(rng.integers(0, length - 40))
            b = a + int(rng.integers(10, 40))
            rows.append(aln(f"q{k}", name, a, b))
            intervals.setdefault(name, []).append((a, b))
    references = refs(spark, *lengths.items())
    return lengths, intervals, frame(spark, rows), references


def test_statistics_against_dense_vectors(spark, random_case):
    lengths, intervals, alns, references = random_case
    stats = {r.reference: r for r in refstats.reference_stats(alns, references).collect()}
    assert set(stats) == set(lengths)
    for name, length in lengths.items():
        cov, r = dense(intervals[name], length), stats[name]
        at = np.flatnonzero(cov)
        nb = n_bins(at, length)
        counts = np.bincount(at * nb // length, minlength=nb)
        t = tad(cov)
        assert r.bases_covered == len(at)
        assert r.coverage_mean == pytest.approx(cov.sum() / length)
        assert r.coverage_covered_mean == pytest.approx(cov.sum() / len(at))
        assert (r.coverage_mean_trunc, r.coverage_mean_trunc_len) == (pytest.approx(t[0]), t[1])
        assert r.cov_evenness == pytest.approx(evenness(cov))
        assert r.c_v == pytest.approx(cov[at].std(ddof=1) / (cov.sum() / length))
        assert r.n_bins == nb + 1
        assert r.entropy == pytest.approx(entropy(counts), abs=1e-9)
        assert r.norm_entropy == pytest.approx(entropy(counts) / entropy(even(counts)), abs=1e-9)
        assert r.gini == pytest.approx(gini(counts), abs=1e-9)
        assert r.norm_gini == pytest.approx(norm_gini(counts), abs=1e-9)


def test_small_tiles_change_nothing(spark, random_case):
    _, _, alns, references = random_case
    hist = lambda tile: sorted(map(tuple, coverage.depth_histogram(coverage.clip(coverage.segments(alns, references, tile), references)).collect()))
    assert hist(64) == hist(1 << 20)
    isles = lambda tile: sorted(map(tuple, coverage.islands(coverage.segments(alns, references, tile)).collect()))
    assert isles(64) == isles(1 << 20)


def test_trim_is_per_reference(spark):
    alns = frame(spark, [aln("a", "r", 0, 50), aln("a", "s", 0, 10)])
    segs = coverage.clip(coverage.segments(alns, refs(spark, ("r", 100), ("s", 15))), refs(spark, ("r", 100), ("s", 15)), trim=10)
    spans = {r.reference: (r.a, r.b) for r in segs.groupBy("reference").agg({"seg_start": "min", "seg_end": "max"}).withColumnsRenamed({"min(seg_start)": "a", "max(seg_end)": "b"}).collect()}
    assert spans == {"r": (10, 90), "s": (0, 15)}


def test_book_ended_and_clipped(spark):
    alns = frame(spark, [aln("a", "r", 0, 10), aln("b", "r", 10, 20), aln("c", "r", 30, 40), aln("d", "r", 95, 110), aln("e", "r", 120, 130)])
    references = refs(spark, ("r", 100))
    raw = coverage.segments(alns, references)
    assert sorted((r.start, r.end) for r in coverage.islands(raw).collect()) == [(0, 20), (30, 40), (95, 110), (120, 130)]
    hist = {r.depth: r.n for r in coverage.depth_histogram(coverage.clip(raw, references)).collect()}
    assert hist == {1: 35, 0: 65}


def test_unscored_reference_fails_every_threshold(spark):
    rows = [aln(f"a{i}", "ok", i * 5, i * 5 + 40) for i in range(5)] + [aln(f"b{i}", "bare", i * 5, i * 5 + 40, score=None if i == 0 else 40) for i in range(5)]
    stats = refstats.reference_stats(frame(spark, rows), refs(spark, ("ok", 100), ("bare", 100)))
    bare = stats.filter("reference = 'bare'").first()
    assert bare.read_aln_score is None and bare.read_ani_mean is None and bare.edit_distances is None
    assert [r.reference for r in refilter.passing(stats, FilterConfig(), None).collect()] == ["ok"]


def test_single_base_has_no_spread(spark):
    stats = refstats.reference_stats(frame(spark, [aln("a", "r", 5, 6)]), refs(spark, ("r", 100))).first()
    assert stats.c_v is None and stats.n_bins == 2 and stats.norm_entropy == 1.0 and stats.norm_gini == 0.0 and stats.read_length_std is None
    assert not refilter.passing(refstats.reference_stats(frame(spark, [aln("a", "r", 5, 6)]), refs(spark, ("r", 100))), FilterConfig(min_read_count=1, min_read_length=1), None).count()


def test_low_detection(spark):
    rows = [aln(f"a{i}", "r", i * 20, i * 20 + 10, seq="GGCA") for i in range(3)]
    stats = refstats.reference_stats(frame(spark, rows), refs(spark, ("r", 100)))
    assert stats.first().cov_evenness == 0.0
    config = dict(min_coverage_evenness=0.5, min_read_length=1)
    assert not refilter.passing(stats, FilterConfig(**config), None).count()
    assert refilter.passing(stats, FilterConfig(**config, include_low_detection=True), None).count() == 1
    assert stats.first().gc_content == pytest.approx(30.0)


def test_missing_mapping_quality(spark):
    stats = refstats.reference_stats(frame(spark, [aln("a", "r", 0, 30), aln("b", "r", 0, 30, mapq=255)]), refs(spark, ("r", 100)))
    assert stats.first().mapping_quality is None


def test_lengths(spark):
    references = refs(spark, ("a", 100), ("b", 200)).drop("reference_length")
    lengths = spark.createDataFrame([("a", 50)], "reference string, length bigint")
    with pytest.raises(align.MissingReferences):
        align.with_lengths(references, lengths)
    got = {r.reference: r.reference_length for r in align.with_lengths(references, lengths, check=False).collect()}
    assert got == {"a": 50, "b": 200}


def test_nothing_passes_identity(spark):
    alns = frame(spark, [aln("a", "r", 0, 30, nm=20)])
    out = pipelines.filter_references(alns, refs(spark, ("r", 100)).drop("reference_length"), FilterConfig(min_read_count=1))
    assert out.stats.columns == list(REF_STATS) and out.stats.count() == 0 and out.passing.count() == 0 and out.alignments.count() == 0


def test_pipeline_counts_and_thresholds(spark):
    rows = [aln(f"q{i}", "r", (i * 13) % 150, (i * 13) % 150 + 40) for i in range(40)] + [aln("z", "s", 0, 40)]
    config = FilterConfig(min_norm_entropy="auto", read_hits_count=True, read_length_freqs=True)
    out = pipelines.filter_references(frame(spark, rows), refs(spark, ("r", 200), ("s", 200)).drop("reference_length"), config)
    assert out.thresholds == (0.75, 0.5)
    assert [r.reference for r in out.stats.collect()] == ["r"]
    assert out.read_hits.agg({"count": "sum"}).first()[0] == 40
    assert out.read_length_freqs.first().freq == [1.0]


def test_half_even(spark):
    from pyspark.sql import functions as F

    from readloom.functions.scalar import half_even

    x = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(half_even(F.col("x"))).collect()
    assert [r[0] for r in x] == [0, 2, 2]


def test_the_sweep_reads_alignments_twice_and_joins_no_segments(spark, tmp_path):
    """Once for the ends, once for the last place of each reference; tiles and clipping need no join of their own."""
    frame(spark, [aln("a", "r", 0, 20), aln("b", "r", 0, 20), aln("c", "r", 90, 130)]).write.parquet(str(tmp_path / "a"))
    refs(spark, ("r", 100), ("s", 15)).write.parquet(str(tmp_path / "r"))
    alns, references = (spark.read.parquet(str(tmp_path / t)) for t in "ar")
    isles = coverage.islands(coverage.segments(alns, references, 16))
    assert sorted(map(tuple, isles.collect())) == [("r", 0, 20), ("r", 90, 130)]
    segs = coverage.clip(coverage.segments(alns, references, 16), references)
    assert sum(r.seg_end - r.seg_start for r in segs.collect()) == 100
    for df in (isles, segs):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 3 and plan.count("Join ") == 1
    stats = coverage.depth_stats(coverage.depth_histogram(segs))
    assert [r.bases_covered for r in stats.collect()] == [30]
    assert str(tmp_path) not in " ".join(stats.inputFiles())  # the sweep isn't done again for the second reading
