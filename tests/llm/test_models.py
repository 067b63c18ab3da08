"""Quality rules (2), secret scan (4), language identification (7), mixing (10)."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import langid, mixing, quality, secretscan

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols if w else 0, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    docs = corpus.awkward(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.assess_quality(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            n = base_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.filter_quality(docs.limit(0)).count() == 0 and quality.assess_quality(docs.limit(0)).count() == 0


def naive_posteriors(patterns, rules, rounds=200):
    """The label model document by document, in plain Python: what the counted, vectorised fit has to agree with."""
    docs = [p for p, n in patterns.items() for _ in range(n)]
    start = {c: dict(zip("01-", quality.START[c], strict=True)) for c in (0, 1)}
    chances = [[dict(start[c]) for c in (0, 1)] for _ in range(rules)]
    prior, hold = 0.85, max(1.0, 0.02 * len(docs))

    def good(p):
        x = [1 - prior, prior]
        for r, v in enumerate(p):
            x = [x[c] * chances[r][c][v] for c in (0, 1)]
        return x[1] / sum(x)

    for _ in range(rounds):
        g = [good(p) for p in docs]
        for r in range(rules):
            for c in (0, 1):
                mass = {v: hold * start[c][v] for v in "01-"}
                for p, x in zip(docs, g, strict=True):
                    mass[p[r]] += x if c else 1 - x
                chances[r][c] = {v: m / sum(mass.values()) for v, m in mass.items()}
        prior = min(0.99, max(0.01, (sum(g) + hold * 0.85) / (len(docs) + hold)))
    return {p: good(p) for p in patterns}


def test_posteriors_against_documents_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    rows = quality.assess_quality(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    votes = {i: quality.pattern(quality.RULES, quality.measure((t or "").encode())) for i, t in texts.items()}
    want = naive_posteriors(Counter(votes[r.doc_id] for r in rows), len(quality.RULES))
    for r in rows:
        assert r.posterior == pytest.approx(want[votes[r.doc_id]], abs=1e-4)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_clashing_columns(spark):
    rows = [(i, "plain words of a text that goes on and on for a while " * 6, "a", "b", "c") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__quality_text` string, votes string, `odd name.x` string")
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns
    assert quality.assess_quality(docs).count() == 4


def test_symbols_without_words():
    assert quality.measure(b" \n") == (0,) * len(quality.COUNTS)


def test_label_model_finds_accuracies():
    rng = random.Random(1)
    chances = [(0.9, 0.05), (0.8, 0.1), (0.7, 0.05)]
    counts = Counter()
    for _ in range(20_000):
        bad = rng.random() < 0.2
        counts["".join("0" if rng.random() < c[0 if bad else 1] else "1" for c in chances)] += 1
    model = quality.fit(dict(counts), 3)
    assert abs(model.prior - 0.8) < 0.05
    assert all(abs(a[0] - c[0]) < 0.1 and abs(1 - a[1] - c[1]) < 0.05 for a, c in zip(model.accuracies(), chances, strict=True))
    assert model.posterior("111") > 0.9 > 0.1 > model.posterior("000")
    assert quality.fit({}, 3).posterior("111") > 0.5


def test_quality_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x = quality.assess_quality(docs).join(labels, "doc_id").groupBy("quality", "kept", "base_failed").count().collect()
    n = {(r.quality, r.kept, r.base_failed): r["count"] for r in x}
    assert not n.get((1, False, False)) and n.get((0, True, False), 0) <= 1


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.learn_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    rows = [(i, f"the quick word {i} and the other") for i in range(30)] + [(100, None), (101, ""), (102, "12 !? 34"), (103, "é")]
    docs = corpus.frame(spark, rows)
    got = {r.doc_id: r for r in langid.learn_and_identify(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0 and got[103].lang_pred == "en"
    unlabelled = langid.learn_and_identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert langid.learn_and_identify(docs.limit(0)).count() == 0
    assert langid.learn_and_identify(corpus.awkward(spark)).count() == corpus.awkward(spark).count()


def test_nearest_centroid_by_hand(spark):
    rng = random.Random(8)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(i, text("abcdefg" if i % 3 else "tuvwxyz"), "one" if i % 3 else "two") for i in range(60)] + [(99, text("cdeftu"), None), (None, text("abc"), "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(langid.training_sample(docs))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[None].held_out is False
    for i, t, _ in rows:
        # cosines one by one, in plain Python
        v = [math.log1p(c) * w for c, w in zip(langid.counts(t).tolist(), model.idf.tolist(), strict=True)]
        norm = math.sqrt(sum(x * x for x in v))
        best = max((sum(a * b for a, b in zip(v, c.tolist(), strict=True)) / norm, -int(o)) for c, o in zip(model.centroids, model.owner, strict=True))
        assert got[i].lang_pred == model.languages[-best[1]]
        if i is not None:
            assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_rejection_by_distance():
    rng = random.Random(2)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
    model = langid.fit([(k, langid.counts(text(v))) for k, v in (("a", "abcde"), ("b", "vwxyz")) for _ in range(20)])
    assert model.predict(text("abcde"))[::2] == ("a", False) and model.predict(text("vwxyz"))[0] == "b"
    assert model.predict(text("ийклм"))[2] is True


def test_secrets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = secretscan.scan(docs)
    held = secretscan.silver_labels(found, secretscan.dictionary(docs)).filter(secretscan.held_out()).select("label", "is_secret").collect()
    assert len(held) > 20 and sum(bool(r.label) == r.is_secret for r in held) / len(held) > 0.95
    keys = docs.filter(F.col("text").rlike("AKIA[0-9A-Z]{16}")).select("doc_id").distinct().count()
    assert found.filter(F.col("candidate").startswith("AKIA") & F.col("is_secret")).select("doc_id").distinct().count() == keys


def planted_findings(seed, n=400):
    """Texts with secrets and look-alikes in much the same surroundings, and what was planted."""
    rng = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    names = ["customer", "invoice", "handler", "factory", "builder", "request", "session", "manager", "provider", "context"]
    prose = lambda n: " ".join(rng.choice(names + ["the", "and", "with", "from", "into"]) for _ in range(n))
    rows, truth = [], {}
    for i in range(n):
        if i % 2:
            value = rng.choice([draw(alnum, 32), draw(alnum + "+/", 40), "eyJ" + draw(alnum, 17) + "." + draw(alnum, 30)])
        else:
            value = rng.choice(["".join(x.capitalize() for x in rng.sample(names, 3)), "/".join(["srv", *rng.sample(names, 3)]), draw("0123456789", 20), "-".join(rng.sample(names, 3)), draw("ab", 24)])
        before = rng.choice(["token =", "key:", "value", "see", "password:", "id"])
        rows.append((i, f"{prose(12)} {before} {value} {prose(12)}"))
        truth[i, value] = float(i % 2)
    return rows, truth


def test_forest_on_independent_labels(spark):
    rows, truth = planted_findings(11)
    docs = corpus.frame(spark, rows)
    known = spark.createDataFrame([(i, c, y) for (i, c), y in truth.items()], "known_id long, known string, label double")
    found = secretscan.findings(docs, secretscan.dictionary(docs))
    labelled = found.join(known, (F.col("doc_id") == F.col("known_id")) & (F.col("candidate") == F.col("known"))).drop("known_id", "known")
    assert labelled.count() >= 0.95 * len(truth)
    scored = secretscan.scan(docs, labelled).filter(secretscan.held_out()).collect()
    pairs = [(truth[r.doc_id, r.candidate], r.is_secret) for r in scored if (r.doc_id, r.candidate) in truth]
    hits = sum(y and p for y, p in pairs)
    flagged, real = sum(p for _, p in pairs), sum(y for y, _ in pairs)
    assert real > 30 and hits >= 0.9 * real and hits >= 0.9 * flagged
    assert len(pairs) - real > 30  # what the forest took away


def test_secret_ties_and_repeats(spark):
    rows = [(5, "x token= a8f3k2j9d7s6h4g5 a8f3k2j9d7s6h4g5"), (5, "x token= a8f3k2j9d7s6h4g5 a8f3k2j9d7s6h4g5"), (None, "token= a8f3k2j9d7s6h4g5")]
    found = secretscan.scan(corpus.frame(spark, rows)).collect()
    assert len(found) == 5 and sum(r.doc_id is None for r in found) == 1
    assert len({(r.word_no, r.probability) for r in found if r.doc_id == 5}) == 2


def test_secret_cases(spark):
    docs = corpus.awkward(spark)
    assert secretscan.scan(docs.limit(0)).count() == 0
    rows = secretscan.scan(docs).collect()
    assert rows and not any(r.is_secret for r in rows if r.candidate.startswith("xxxx"))
    text = 'call x(1) password="a8f3k2j9d7s6h4g5" and /usr/lib/python3/something/else.py then Thisisaverylongword'
    got = {r.candidate: r for r in secretscan.findings(corpus.frame(spark, [(1, text), (2, None)]), spark.createDataFrame([("this",), ("long",)], "w string")).collect()}
    assert set(got) == {"a8f3k2j9d7s6h4g5", "/usr/lib/python3/something/else", "Thisisaverylongword"}
    secret = got["a8f3k2j9d7s6h4g5"]
    assert secret.hint_inside == 1 and secret.assigned == 1 and secret.quoted == 1 and secret.slashes == 0
    assert got["/usr/lib/python3/something/else"].path_marks == 1
    assert got["Thisisaverylongword"].dictionary_share == pytest.approx(8 / 19)


def test_secret_coverage_brute_force(spark):
    """Covered letters against all substrings, one by one; candidates longer than a piece and without any word."""
    rng = random.Random(8)
    words = ["this", "long", "longer", "path", "ngerp", "underscore", "abcdefghijklmnopqrst"]
    texts = ["".join(rng.choice([*words, "Q7", "-", "x9z", "THIS", "on"]) for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["x" * 5000, "longerpath" * 300, "7" * 70, ""]
    got = {r.candidate: r.covered for r in secretscan.coverage(spark.createDataFrame([(t,) for t in texts], "candidate string"), spark.createDataFrame([(w,) for w in words], "w string")).collect()}
    for t in texts:
        low, places = t.lower(), set()
        for w in words:
            for i in range(len(low)):
                if low.startswith(w, i):
                    places |= set(range(i, i + len(w)))
        assert got.get(t, 0) == len(places)


def test_secret_dictionary_and_short_values(spark):
    rows = [(k, "größe des größten hauses préférée fort 'the' zugang") for k in range(6)] + [(9, 'x password = hunter22! then passwort: Sommer-2024 token="ab12cd34" author Mustermann plain99word pass: mypass99')]
    docs = corpus.frame(spark, rows)
    assert {r.w for r in secretscan.dictionary(docs).collect()} == {"hauses", "preferee", "fort", "zugang"}
    assert secretscan.dictionary(docs.limit(0)).count() == 0 == secretscan.dictionary(docs, share=0.5).count()
    found = {r.candidate for r in secretscan.candidates(docs).collect()}
    assert found == {"hunter22!", "Sommer-2024", "ab12cd34", "Mustermann", "plain99word", "mypass99"}


def test_secret_marks(spark):
    """Marks for labels: bits of words lie below those of random values; decoded headers; digests are no secrets."""
    rng = random.Random(2)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ren", "sta"]) for _ in range(4)) for _ in range(200)]
    given = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    signed = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.c2lnbmF0dXJlLW9mLWl0"
    texts = [" ".join(words)] * 6 + [f"token = '{given}' and", f"commit {given} and", f"see {signed} and", "id 123e4567-e89b-12d3-a456-426614174000 and", "ref kalomirensta/kalostamiren/loka and", "no 1234567890123456789 and"]
    docs = corpus.frame(spark, list(enumerate(texts)))
    dictionary = secretscan.dictionary(docs)
    labels = {(r.doc_id, r.candidate): r.label for r in secretscan.silver_labels(secretscan.findings(docs, dictionary), dictionary).collect() if r.doc_id >= 6}
    assert labels == {(6, given): 1.0, (7, given): 0.0, (8, signed): 1.0, (9, "123e4567-e89b-12d3-a456-426614174000"): 0.0, (10, "kalomirensta/kalostamiren/loka"): 0.0, (11, "1234567890123456789"): 0.0}


def water_fill(sizes, weights, budget):
    target, full = {}, set()
    while True:
        rest = budget - sum(3 * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and rest * weights[s] / w > 3 * sizes[s]} if w else set()
        if not over:
            return {s: 3.0 * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        full |= over


def test_mix_targets_and_shares(spark):
    rng = random.Random(3)
    rows, spread = [], {"a": 200, "b": 12, "c": 3, "d": 60, None: 30}
    for s, n in spread.items():
        rows += [(len(rows) + k, " ".join("w" for _ in range(rng.randrange(0, 40))), s) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: 1 + i % 3 for i, s in enumerate(order)}
    want = water_fill(sizes, weights, sum(sizes.values()))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 * 40 for s in sizes)
    assert sum(sizes.values()) - 40 <= sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    # within a pass, a source is served in one order: documents of more passes come before those of fewer
    assert len({r.passes for r in got if r.source == "a"}) <= 2


def test_mix_cases(spark):
    docs = corpus.awkward(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken == r.passes * r.size for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = mixing.mix(corpus.frame(spark, [(1, None), (2, "")])).collect()
    assert [(r.size, r.taken, r.target) for r in empty] == [(0, 0, 0.0)] * 2


def test_mix_order(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 30))), rng.choice("abc")) for i in range(120)]
    rows += [(7, "one two three", "a"), (7, "four five six seven", "a"), (None, "null id", "b"), (None, "null id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    picked = mixing.mix(docs).collect()
    order = mixing.mix_documents(docs.withColumn("__own_h", F.lit(1)).withColumn("size", F.lit("x")))
    assert order.columns == ["doc_id", "text", "source", "__own_h", "size"]
    served = order.collect()
    want = Counter()
    for r in picked:
        want[r.doc_id, r.source, r.size] += r.passes
    assert Counter((r.doc_id, r.source, len(WORD.findall(r.text))) for r in served) == +want
    # the rows of a source come pass after pass, and the first ones by virtual finish time
    finish = {(r.doc_id, r.source, r.size): r.finish_time for r in picked}
    firsts = list(dict.fromkeys((r.doc_id, r.source, len(WORD.findall(r.text))) for r in served))
    for s in "abc":
        times = [finish[x] for x in firsts if x[1] == s]
        assert times == sorted(times)


def test_word_count_matches(spark):
    rows = corpus.documents()
    got = {r[0]: r[1] for r in corpus.frame(spark, rows).select("doc_id", mixing.word_count(F.col("text"))).collect()}
    assert got == {i: len(WORD.findall(t or "")) for i, t in rows}


def test_label_model_is_finite():
    model = quality.fit({"-" * len(quality.RULES): 10}, len(quality.RULES))
    assert np.isfinite(model.posterior("0" * len(quality.RULES)))
