"""Toxicity: probabilities against a plain Kneser-Ney, held-out accuracy, cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from readloom.llm import toxicity
from readloom.llm.toxicity import ORDER, Model, gram_counts, learn, learn_and_score, score_documents

SF = "/root/testdata/sf0.01"


def plain(words):
    """Functions P(letter | history) of class 1, class 0 and of both, from the definition."""
    marked = {c: {f"^{w}$": n for (k, w), n in words.items() if k == c} for c in (0, 1)}
    marked[2] = Counter(marked[0]) + Counter(marked[1])

    def counts(of):
        raw, out = Counter(), Counter()
        for s, n in of.items():
            for i in range(1, len(s)):
                for k in range(1, min(i + 1, ORDER) + 1):
                    raw[s[i - k + 1 : i + 1]] += n
        for g, n in raw.items():
            out[g] = n if len(g) == ORDER or g[0] == "^" else len({h for h in raw if len(h) == len(g) + 1 and h[1:] == g})
        return out

    found = {c: counts(marked[c]) for c in (0, 1, 2)}
    alphabet = {g for g in found[2] if len(g) == 1}
    total = sum(found[2][a] for a in alphabet)

    def p(c, h, w):
        if not h:
            return (found[2].get(w) or 1) / total
        tail = {g: v for g, v in found[c].items() if len(g) == len(h) + 1 and g[:-1] == h}
        if not tail:
            return p(c, h[1:], w)
        d, n = 0.75, sum(tail.values())
        return max(0, tail.get(h + w, 0) - d) / n + d * len(tail) / n * p(c, h[1:], w)

    return p, alphabet


def test_against_plain_models(spark):
    words = {(1, "idle"): 3, (1, "idol"): 2, (1, "the"): 5, (0, "the"): 7, (0, "theory"): 1, (0, "idea"): 2, (0, "identical"): 1, (1, "a"): 2, (0, "a"): 1}
    rows = spark.createDataFrame([(c, w, n) for (c, w), n in words.items()], "toxic int, word string, n bigint")
    model = toxicity.assemble(sorted(tuple(r) for r in gram_counts(rows).collect()), 0.5)
    p, alphabet = plain(words)
    for word in ("idle", "identical", "theidle", "x", "ax", "identicalidentical"):
        s, want = f"^{word}$", 0.0
        for i in range(1, len(s)):
            h = s[max(0, i - ORDER + 1) : i]
            want += math.log(p(1, h, s[i]) / p(0, h, s[i]))
        assert model.word(word) == pytest.approx(want, abs=1e-9)
    for c in (0, 1):  # the model of each class is a distribution over the letters
        assert sum(p(c, "^id", a) for a in alphabet) == pytest.approx(1)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = learn_and_score(docs, labels)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").filter("toxic is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    bad, good = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    above = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    # Forty labels, of which those on other languages than English mark nothing that a text shows; README has large tables.
    assert len(bad) >= 5 and above > 0.65
    assert out.count() == docs.count()


def _tables(spark):
    rng = np.random.default_rng(3)
    plain_words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain_words, 30))
        if i % 3 == 0:
            words[4], words[17] = "zorgfilth", "zorgswine"
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(i % 3 == 0)))
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "123 !?", "x"), (None, "zorgfilth zorgrat", "x"), (1003, "zorgswine zorgfilth " * 20000, "x"), (1003, "zorgswine zorgfilth " * 20000, "x")]
    labels += [(None, 1, 1), (1, 1, None), (7, 1, 1), (1001, 0, 0)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_cases(spark):
    docs, labels = _tables(spark)
    rows = learn_and_score(docs, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in rows if r.held_out and r.doc_id < 1000)
    assert got[1000].score == got[1001].score == got[1002].score < 0.5 and got[1000].n_distinct_words == 0
    assert got[None].held_out is False and got[1003].predicted in (0, 1) and len({r.score for r in rows if r.doc_id == 1003}) == 1
    assert got[None].evidence > 1 and got[1003].evidence > 1
    again = {r.doc_id: r.score for r in learn_and_score(docs.repartition(7), labels).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in got.items())
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1).otherwise(toxicity.F.col("toxic")))
    assert {r.doc_id: round(r.score, 9) for r in learn_and_score(docs, other).collect()} == {k: round(r.score, 9) for k, r in got.items()}


def test_one_class_or_none(spark):
    docs, labels = _tables(spark)
    few = docs.limit(20)
    assert {r.score for r in learn_and_score(few, labels.filter("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in learn_and_score(few, labels.filter("toxic = 1 and doc_id % 3 = 0")).collect()} == {1.0}
    assert {r.predicted for r in learn_and_score(few, labels.limit(0)).collect()} == {0}
    assert learn_and_score(docs.limit(0), labels).collect() == []
    model = learn(docs, labels)
    assert isinstance(model, Model) and score_documents(few.select("doc_id", "text"), model).count() == 20
