"""Periodic runs against a look at every place and period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm.wordruns import balanced, re_pair, run_reports, runs

SF = "/root/testdata/sf0.001"


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)  # periods go up: the least one stays
            i = j + 1 if j == i else j
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def ids(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4))
def test_small_alphabets(texts):
    assert runs([np.array(t, np.int64) for t in texts]) == [brute(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_nested_repeats(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(4)):
            a, p, k = rng.randrange(len(words) + 1), rng.randrange(1, 40), rng.randrange(2, 7)
            words[a:a] = words[a : a + p] * k + words[a : a + p // 2]
        texts.append(words)
    assert runs([ids(t) for t in texts]) == [brute(t) for t in texts]


def test_fibonacci_and_single_word():
    a, b = "a", "ab"
    while len(b) < 800:
        a, b = b, b + a
    texts = [list(b), ["x"] * 5000, ["x"] * 11, ["x"] * 12, list("abcdef" * 2), list("abcde" * 2), []]
    got = runs([ids(t) for t in texts])
    assert got == [brute(t) for t in texts]
    assert got[1] == [(0, 5000, 1)] and got[2] == [] and got[3] == [(0, 12, 1)] and got[4] == [(0, 12, 6)] and got[5] == []


def test_grammar_spells_the_text():
    rng = random.Random(5)
    text = [rng.randrange(4) for _ in range(300)] * 3
    ends = np.array([100, 100, 900])
    symbols, rest = re_pair(np.array(text), ends)
    for k in range(len(symbols.low)):
        places = symbols.place[symbols.owner == k]
        n, m = symbols.high[k] - symbols.low[k], symbols.boundary[k] - symbols.low[k]
        assert len(places) >= 2 and 0 < m < n
        assert len({tuple(text[p : p + n]) for p in places}) == 1 and all(not p < 100 < p + n for p in places)
    pairs = [tuple(text[a:c]) + (b - a,) for a, b, c in zip(rest, rest[1:], [*rest[2:], 900], strict=False) if b not in (100,) and not a < 100 < c]
    assert len(rest) < 200 and len(pairs) == len(set(pairs)) or len(rest) < 60
    low, boundary, high = balanced(rest, ends)
    assert len(low) == len(rest) - 2 and (low < boundary).all() and (boundary < high).all()


def whole(doc_id, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else (None, None, None)
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


@pytest.mark.parametrize("plant", [False, True])
def test_documents(spark, plant):
    rows = [(i, t, 1) for i, t in enumerate(["a b " * 9, None, "", " \n\t", "x y z\x0bq " * 6, "no run here at all", " ".join("ab") + " c" * 13, "p q r s t u " * 3 + "p q"])]
    rows += [(1, "a b " * 9, 2), (None, "k " * 40, 0), (90, "one two three four " * 20 + "end", 0), (14, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 4, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    assert sorted(map(str, run_reports(df, plant).collect())) == sorted(str(_row(whole(*r[:2], plant))) for r in rows)
    assert run_reports(df.limit(0)).collect() == []


def _row(values):
    from pyspark.sql import Row

    return Row(doc_id=values[0], n_runs=values[1], start=values[2], length=values[3], period=values[4], exponent_milli=values[5], runs_sha256=values[6], collapsed_sha256=values[7])


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("length(text) < 6000")
    want = {r.doc_id: whole(r.doc_id, r.text, True) for r in docs.collect()}
    got = {r.doc_id: tuple(r) for r in run_reports(docs, True).collect()}
    assert got == want and sum(r[1] > 0 for r in got.values()) > 10
