import math
import random
import statistics
import time
from collections import defaultdict

import pytest
from fixtures import aln, frame, refs
from pyspark.sql import functions as F

from readloom.config import ReassignConfig
from readloom.operators import align, em
from readloom.plans import pipelines


def brute(scores, lengths, iters, scale):
    """Plain dictionaries: (query, reference) -> probability."""
    total = defaultdict(float)
    for (q, _), s in scores.items():
        total[q] += s
    prob = {k: s / total[k[0]] for k, s in scores.items()}
    n = 0
    while True:
        weight = defaultdict(float)
        for (_, r), p in prob.items():
            weight[r] += p
        new = {(q, r): p * weight[r] / lengths[r] for (q, r), p in prob.items()}
        total, hits = defaultdict(float), defaultdict(int)
        for (q, _), p in new.items():
            total[q] += p
            hits[q] += 1
        prob = {k: p / total[k[0]] for k, p in new.items()}
        if all(h == 1 for h in hits.values()):
            return prob
        best = defaultdict(float)
        for (q, _), p in prob.items():
            best[q] = max(best[q], p)
        kept = {k: p for k, p in prob.items() if hits[k[0]] == 1 or p >= best[k[0]] * scale}
        removed, prob, n = len(prob) - len(kept), kept, n + 1
        if not removed or (iters and n >= iters):
            return prob


def state(spark, scores, lengths):
    s = spark.createDataFrame([(q, r, float(v)) for (q, r), v in scores.items()], "query string, reference string, score double")
    return em.initial(s, spark.createDataFrame(list(lengths.items()), "reference string, reference_length bigint"))


@pytest.mark.parametrize("iters", [0, 2])
def test_against_dictionaries(spark, iters):
    rng = random.Random(4)
    lengths = {f"r{i}": rng.randrange(100, 900) for i in range(6)}
    scores = {(f"q{i}", r): rng.uniform(0.1, 2) for i in range(60) for r in rng.sample(sorted(lengths), rng.randrange(1, 5))}
    want = brute(scores, lengths, iters, 0.9)
    rows = em.resolve(state(spark, scores, lengths), iters, 0.9).collect()
    got = {(r["query"], r["reference"]): r["prob"] for r in rows}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    per = defaultdict(int)
    for q, _ in got:
        per[q] += 1
    assert all(r["n_aln"] == per[r["query"]] for r in rows) and set(per) == {q for q, _ in scores}


def test_all_unique_returns_at_once(spark):
    rows = em.resolve(state(spark, {("a", "x"): 1, ("b", "y"): 2}, {"x": 10, "y": 10}), 25, 0.9).collect()
    assert [(r["prob"], r["iter"]) for r in rows] == [(1.0, 0), (1.0, 0)]


def test_ties_and_skew(spark):
    tie = em.resolve(state(spark, {("a", "x"): 1, ("a", "y"): 1}, {"x": 10, "y": 10}), 0, 0.9)
    assert tie.count() == 2
    skew = em.resolve(state(spark, {("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 1, ("c", "x"): 1}, {"x": 10, "y": 10}), 0, 0.9)
    assert {(r["query"], r["reference"]) for r in skew.collect()} == {("a", "x"), ("b", "x"), ("c", "x")}


def test_score_shift_is_per_reference(spark):
    alns = frame(spark, [aln("a", "x", 0, 40, nm=0), aln("b", "x", 0, 40, nm=2), aln("b", "y", 0, 50, nm=1, xo=1, xg=1)])
    got = {(r["query"], r["reference"]): r["score"] for r in align.normalised_scores(alns).collect()}
    # rewards: 40 - 0 = 40; 38 + 4 = 42; the only one of y begins at 1
    assert got == {("a", "x"): pytest.approx(1 / 40), ("b", "x"): pytest.approx(3 / 40), ("b", "y"): pytest.approx(1 / 50)}


def test_all_records_of_a_pair_survive(spark):
    rows = [aln(f"q{i}", "x", i, i + 40) for i in range(4)] + [aln("q0", "x", 50, 90, nm=30), aln("q1", "y", 0, 40, nm=1)]
    out = pipelines.reassign(frame(spark, rows), refs(spark, ("x", 100), ("y", 100)).drop("reference_length"), ReassignConfig(min_read_count=2))
    assert out.alignments.count() == 5 and out.alignments.filter(F.col("reference") == "y").count() == 0


def test_empty(spark):
    out = pipelines.reassign(frame(spark, []), refs(spark, ("x", 100)).drop("reference_length"))
    assert out.pairs.count() == 0 and out.alignments.count() == 0


def doubling(passes):
    """Queries of two references each, on their own: the log odds double in each pass, so one query is settled a pass."""
    scores, lengths = {}, {}
    for k in range(passes):
        odds = math.exp(-math.log(0.9) * 1.5 / 2 ** (k + 1))
        for side, score in (("a", odds), ("b", 1.0)):
            scores[f"q{k}", f"{side}{k}"], lengths[f"{side}{k}"] = score, 100
    return scores, lengths


def test_25_passes_in_bounded_time(spark):
    """State tables carry no estimate of earlier passes, so a late pass takes no longer than an early one."""
    times, began = [], [time.perf_counter()]

    def report(number, removed):
        times.append(time.perf_counter() - began[0])
        began[0] = time.perf_counter()
        assert removed == 1

    scores, lengths = doubling(30)
    out = em.resolve_passes(state(spark, scores, lengths), 25, 0.9, report)
    assert len(times) == 25 and out.state.count() == 60 - 25
    assert sum(times) < 120 and statistics.median(times[-5:]) < 2 * statistics.median(times[2:8])
    got = [tuple(r) for r in out.tallies.orderBy("pass").collect()]
    assert got[0] == (0, 60, 60, 0, 0) and got[1:] == [(k, 60 - k, 62 - 2 * k, 1, 1) for k in range(1, 26)]


def test_goes_on_after_a_lost_driver(spark, tmp_path):
    scores, lengths = doubling(7)
    whole = sorted(tuple(r) for r in em.resolve(state(spark, scores, lengths), 25, 0.9).collect())
    folder = f"file://{tmp_path}/run"

    def lost(number, removed):
        if number == 4:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        em.resolve_passes(state(spark, scores, lengths), 25, 0.9, lost, folder)
    later = []
    for _ in range(2):  # the second run finds the loop ended
        out = em.resolve_passes(state(spark, scores, lengths), 25, 0.9, lambda number, removed: later.append(number), folder)
        assert sorted(tuple(r) for r in out.state.collect()) == whole
    assert later == [5, 6, 7, 8]
    assert sorted(p.name for p in (tmp_path / "run/rows").iterdir()) == ["pass=7", "pass=8"]
