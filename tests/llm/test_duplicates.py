"""N-gram join (3), repeated byte strings (5) and like lines (8) against brute force."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import corpus
import numpy as np
import pytest

from readloom.llm import lshforest, suffixdedup
from readloom.llm import linededup as ld
from readloom.llm.components import components
from readloom.llm.kernels import gram_hashes, shingle_hashes, sliding_min, word_hashes
from readloom.llm.runtime import Scratch

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def tokens(text):
    return [w for w in SPACE.split(text or "") if w]


def test_kernels():
    data = np.frombuffer(b"abcabcabcxyz" * 9, np.uint8)
    for k in (1, 2, 3, 5, 7, 12, 31):
        h = gram_hashes(data, k)
        assert len(h) == len(data) - k + 1
        assert len(set(h.tolist())) == len({bytes(data[i : i + k]) for i in range(len(h))})
    x = np.random.default_rng(1).integers(0, 1000, 300).astype(np.uint64)
    assert sliding_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(294)]
    a, b = word_hashes(b"one two  one\nthree"), word_hashes(b"three one")
    assert a[0] == a[2] and a[3] == b[0] and b[1] == a[0] and len(set(a.tolist())) == 3
    assert len(shingle_hashes(word_hashes(b"a b c"), 5)) == 1 and not len(shingle_hashes(word_hashes(b" "), 5))


def test_long_texts_hash_in_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)).encode() + b"\n" + b"x" * 500
    want = word_hashes(text).tolist()
    monkeypatch.setattr("readloom.llm.kernels.CHUNK", 200)
    assert word_hashes(text).tolist() == want and len(want) == 3001


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in (100, 101, 102)) and all(got[i] == 200 for i in range(200, 260))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_brute(rows):
    sets = {}
    for i, t in rows:
        w = tokens(t)
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    links, parent = defaultdict(int), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("limits", [{}, {"GRAMS": 300, "SETS": 3, "SIGNATURES": 2, "BROADCAST_ROWS": 0}])
def test_near_duplicates(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lshforest, name, value)
    rows = corpus.documents()
    # rows that repeat count as one document
    got = {r.doc_id: (r.class_id, r.n_links) for r in lshforest.near_duplicates(corpus.frame(spark, [*rows, rows[0], rows[0], rows[41], rows[48]])).collect()}
    want = near_brute(rows)
    assert got == want and max(v[1] for v in want.values()) >= 5


def variants(seed, groups=12, size=9, similar=(0.8, 1.0)):
    """Groups of texts at all similarities around the threshold, by words exchanged in a row."""
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in rng.integers(0, 10_000, 150)]
        for v in range(size):
            words = list(base)
            n = int(rng.integers(0, 16))
            at = int(rng.integers(0, 150 - n))
            words[at : at + n] = [f"v{v}x{k}g{g}" for k in range(n)]
            out.append((g * 100 + v, " ".join(words)))
    return out


@pytest.mark.parametrize("shape", [{}, {"trees": 8, "depth": 6}, {"trees": 16, "depth": 3}])
def test_recall_of_links(spark, shape):
    rows = variants(3)
    want = near_brute(rows)
    got = {r.doc_id: r.n_links for r in lshforest.near_duplicates(corpus.frame(spark, rows), **shape).collect()}
    assert all(got[i] <= n for i, (_, n) in want.items())
    assert sum(got.values()) >= 0.95 * sum(n for _, n in want.values()) > 100


def test_leaves_know_their_neighbours(spark):
    rng = np.random.default_rng(4)
    sigs = [(i, rng.integers(0, 3, 12).astype(">u2").tobytes()) for i in range(60)]
    df = spark.createDataFrame(sigs, "id long, sig binary").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep the many small ranges
    try:
        got = {(r.id, r.tree): r.matched for r in lshforest.trie_leaves(df, 3, 4).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for t in range(3):
        labels = {i: s[8 * t : 8 * t + 8] for i, s in sigs}
        for i, x in labels.items():
            best = max(next((k for k in range(4) if x[2 * k : 2 * k + 2] != y[2 * k : 2 * k + 2]), 4) for j, y in labels.items() if j != i)
            assert got.get((i, t), 0) == (best if best >= lshforest.LEAST else got.get((i, t), 0))


def test_rows_and_links_of_blocks():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert lshforest.overlaps(sets, sets, 7).tolist() == want
    assert lshforest.overlaps(sets[:9], sets[9:], 7).tolist() == [row[9:] for row in want[:9]]
    whole = lshforest.verify(list(range(30)), [1] * 30, [0] * 30, sets, 0.45)
    split = [lshforest.verify(list(range(30)), [1] * 30, [1] * 9 + [2] * 21, sets, 0.45), lshforest.verify(list(range(9)), [1] * 9, [0] * 9, sets[:9], 0.45), lshforest.verify(list(range(9, 30)), [1] * 21, [0] * 21, sets[9:], 0.45)]
    counts = defaultdict(int)
    for part in split:
        for i, _, n, _ in part:
            counts[i] += n
    assert dict(counts) == {i: n for i, _, n, _ in whole} and counts


def test_one_of_each_class_stays(spark):
    docs = corpus.awkward(spark)
    want = near_brute(corpus.documents())
    kept = lshforest.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == {r[0] for r in corpus.documents() if r[0] not in want or want[r[0]][0] == r[0]}
    assert ids.count(None) == 2
    assert lshforest.drop_near_duplicates(docs.limit(0)).count() == 0


def test_level_follows_the_pairs_at_hand():
    level = lambda agree: lshforest.matched_level(agree, 16, 8, 0.8, 0.998, 0.99)
    assert lshforest.found_at(0.8, 6) >= 0.99 > lshforest.found_at(0.8, 7)
    assert level({}) == 6 and level({126: 50}) == 6 and level({40: 10**6}) == 6
    # many pairs near the threshold need a shorter prefix
    assert level({103: 50}) == 5


def repeats_brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for p in range(len(x) - 99):
            if x[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(x[p : p + 100])
        spans = sum(1 for j in range(len(x)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "fan"), [(suffixdedup.HOT, 256), (3, 2)])
def test_repeats(spark, monkeypatch, hot, fan):
    monkeypatch.setattr(suffixdedup, "WINDOWS", 500)
    monkeypatch.setattr(suffixdedup, "FANIN", fan)
    rows = corpus.documents()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(corpus.frame(spark, rows), hot=hot).collect()}
    assert got == repeats_brute(rows)


def test_repeats_awkward(spark):
    docs = corpus.awkward(spark)
    rows = suffixdedup.remove_repeats(docs, with_text=True).collect()
    assert len(rows) == docs.count() and all(r.n_bytes - r.n_removed == len(r.kept) for r in rows)
    again = [(r.n_removed, r.kept_sha256) for r in rows if r.doc_id == 21]
    assert len(again) == 3 and len(set(again)) == 1
    assert suffixdedup.remove_repeats(docs.limit(0)).count() == 0


def test_loser_tree_and_front_coding():
    rng = np.random.default_rng(2)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(rng.integers(0, 30))) for _ in range(7)]
    coded = [suffixdedup.front_code(r) for r in runs]
    assert [[s for _, s in suffixdedup.decode_run(*c)] for c in coded] == runs
    out = list(suffixdedup.LoserTree([suffixdedup.decode_run(*c) for c in coded]))
    assert [s for _, s, _ in out] == sorted(s for r in runs for s in r)
    before = b""
    for known, s, _ in out:
        assert known == suffixdedup.shared_prefix(before, s)
        before = s


def lines_brute(rows):
    lines = [(i, j, x, frozenset(tokens(x))) for i, t in sorted(rows, key=lambda r: r[0]) if t is not None for j, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[3]]
    first, reps, gone = set(), [], set()
    for x in lines:
        if x[2] in first:
            gone.add(x[:2])
            continue
        first.add(x[2])
        for y in reps:
            n = len(x[3] & y[3])
            if 5 * n >= 4 * (len(x[3]) + len(y[3]) - n):
                gone.add(x[:2])
                break
        reps.append(x)
    return lines, gone


@pytest.mark.parametrize("broadcast", [ld.BROADCAST_ROWS, 0])
def test_lines(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ld, "BROADCAST_ROWS", broadcast)
    rows = corpus.documents()
    docs = corpus.frame(spark, rows)
    lines, gone = lines_brute(rows)
    got = {r.doc_id: r for r in ld.line_verdicts(docs).collect()}
    assert len(got) == len(rows) and gone
    for i, _ in rows:
        own = [x[1] for x in lines if x[0] == i]
        kept = [j for j in own if (i, j) not in gone]
        assert (got[i].n_lines, got[i].n_removed) == (len(own), len(own) - len(kept))
        assert got[i].kept_lines_sha256 == hashlib.sha256(",".join(map(str, kept)).encode()).hexdigest()
    out = {r.doc_id: r.text for r in ld.dedup_documents(docs).collect()}
    for i, t in rows:
        own = [x[1] for x in lines if x[0] == i]
        if own and all((i, j) in gone for j in own):
            assert i not in out
        elif t is None:
            assert out[i] is None
        else:
            assert out[i] == "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone)


def test_bitmaps_are_small_and_lose_no_pair(spark):
    """Two numbers a line, the second only for long lines; pairs at the threshold pass, folded or not."""
    from pyspark.sql import functions as F

    sizes = [40, 88, 95, 96, 104, 130, 300, 700]
    rows = [(2 * i + j, " ".join([f"s{i}x{k}" for k in range(n - n // 9)] + [f"d{i}x{j}x{k}" for k in range(n // 9)])) for i, n in enumerate(sizes) for j in (0, 1)]
    rows += [(100, " ".join(f"t{k}" for k in range(90))), (101, " ".join(f"t{k}" for k in range(110)))]  # of 64 and of 128 bits
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = ld.Scratch.table(ld.line_signatures(docs, 80), "test-signatures")
    assert [c for c in signed.columns if c.startswith("b")] == ["b0", "b1"]
    assert all((r.b1 != 0) == (r.n >= ld.WIDE) for r in signed.collect())
    pairs = ld.candidate_pairs(signed, signed.select("lid").limit(0), 80)
    ids = signed.select(F.col("lid").alias("lid2"), "doc_id")
    assert sorted(r.doc_id // 2 for r in pairs.join(ids, "lid2").collect()) == [*range(len(sizes)), 50]
    assert sorted(r.doc_id for r in ld.line_verdicts(docs).filter("n_removed > 0").collect()) == [*range(1, 2 * len(sizes), 2), 101]


def test_lines_awkward(spark):
    docs = corpus.awkward(spark)
    out = ld.dedup_documents(docs)
    assert out.columns == docs.columns and out.filter("doc_id is null and text is null").count() == 1
    assert ld.line_verdicts(docs).count() == docs.count() and ld.line_verdicts(docs.limit(0)).count() == 0
    assert ld.dedup_documents(docs.limit(0)).count() == 0


def test_sets_have_two_hashes_of_their_own(spark):
    """The second hash of a set of words is no function of the first, so that one collision merges no unlike lines."""
    from pyspark.sql import functions as F

    from readloom.llm import linededup

    source = __import__("inspect").getsource(linededup.line_signatures)
    assert 'F.xxhash64(F.lit(1), "keys")' in source
    keys = spark.range(200).select(F.array("id", F.col("id") + 1, F.col("id") * 7).alias("keys"))
    hashes = keys.select(F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"))
    # hashing a constant on top of h1 is what h2 must not be
    chained = keys.select(F.xxhash64("keys", F.lit(1)).alias("h"))
    assert hashes.select("h2").intersect(chained.select(F.col("h").alias("h2"))).count() == 0 and hashes.distinct().count() == 200


@pytest.mark.parametrize("limits", [{"STEP": 3, "RELAYED": 50, "RANGE_STRINGS": 20}, {"STEP": 2, "RELAYED": 10**6, "RANGE_STRINGS": 50}])
def test_repeats_by_several_exchanges(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffixdedup, name, value)
    rows = corpus.documents()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(corpus.frame(spark, rows)).collect()}
    assert got == repeats_brute(rows)


def test_relayed_entries(monkeypatch):
    """Whatever the exchanges, each range ends up with the same repeated hashes; a hot hash arrives as few entries."""
    rng = np.random.default_rng(8)
    ranges, hot = 90, int(rng.integers(0, 2**63, dtype=np.uint64))
    first = []
    for batch in range(40):
        h = np.concatenate([rng.integers(0, 2**64, 300, dtype=np.uint64), np.array([hot, hot], np.uint64)])
        h[:5] = np.arange(5, dtype=np.uint64) << np.uint64(60)
        h, owner, count = suffixdedup._counted(h, np.full(len(h), batch % 7, np.int64), np.ones(len(h), np.int64))
        first.append((h, owner, count))

    def flags(steps):
        batches = [suffixdedup._dealt(h, o, c, np.where(c > 0, suffixdedup._range_of(h, ranges), o % ranges), steps[0]) for h, o, c in first]
        for wide, width in zip(steps, steps[1:], strict=False):
            rows = sorted((x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), key=lambda x: x[0])
            table = suffixdedup.pa.table({"range": [r for r, _ in rows], "blob": suffixdedup.pa.array([b for _, b in rows], suffixdedup.pa.binary())})
            batches = list(suffixdedup._relayed(iter(table.to_batches(max_chunksize=7)), ranges, wide, width))
        by_range = defaultdict(list)
        for b in batches:
            for r, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_range[r].append(blob)
        out, entries = set(), 0
        for r, blobs in by_range.items():
            entries += sum(int((suffixdedup._unpack(x, "u8", "u4", "u4")[0] == hot).sum()) for x in blobs if r == int(suffixdedup._range_of(np.array([hot], np.uint64), ranges)[0]))
            got = suffixdedup._repeated(suffixdedup.pa.table({"blob": suffixdedup.pa.array(blobs, suffixdedup.pa.binary())}), 10**9)
            for bucket, blob in zip(got.column("bucket").to_pylist(), got.column("flags").to_pylist(), strict=True):
                out |= {(bucket, int(x)) for x in suffixdedup._unpack(blob, "u8")[0]}
        return out, entries

    monkeypatch.setattr(suffixdedup, "RELAYED", 5000)
    want, many = flags([1])
    got, few = flags([10, 1])
    assert got == want and len({h for _, h in want}) == 6
    assert many == 40 and few < 15
    assert suffixdedup._steps(90) == [1] and suffixdedup._steps(5000) == [71, 1] and suffixdedup._steps(8) == [1]


def test_blocks_by_size(spark, monkeypatch):
    """Every pair of members that sizes allow meets in exactly one task; pairs of unlike sizes are not all tried."""
    monkeypatch.setattr(lshforest, "SETS", 4)
    monkeypatch.setattr(lshforest, "GRAMS", 400)
    rng = np.random.default_rng(5)
    sizes = {i: int(n) for i, n in enumerate(rng.choice([3, 10, 11, 40, 90, 95, 150, 700, 900], 120))}
    rows = [(i % 2, i, n) for i, n in sizes.items()]
    got = lshforest.block_tasks(spark.createDataFrame(rows, "cluster long, id long, n long"), 0.8).collect()
    assert sorted(r.id for r in got) == sorted(sizes)
    met = defaultdict(int)
    tasks = defaultdict(list)
    for r in got:
        for one, two, side in r.tasks:
            tasks[r.cluster, one, two].append((r.id, side))
    for members in tasks.values():
        for (i, a), (j, b) in combinations(members, 2):
            if a == b == 0 or {a, b} == {1, 2}:
                met[min(i, j), max(i, j)] += 1
    assert set(met.values()) == {1}
    for i, j in combinations(sizes, 2):
        if i % 2 == j % 2 and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]):
            assert (i, j) in met
    assert len(met) < 0.6 * sum(1 for i, j in combinations(sizes, 2) if i % 2 == j % 2)


def test_low_thresholds_keep_short_prefixes(spark):
    assert lshforest.least_level(16, 0.8, 0.998, 0.99) == 2 and lshforest.least_level(16, 0.4, 0.998, 0.99) == 1
    with pytest.raises(ValueError, match="trees"):
        lshforest.least_level(16, 0.2, 0.998, 0.99)


def test_settled_lines_do_not_meet(spark):
    """Only pairs with an open later line are candidates."""
    base = [f"w{k}" for k in range(20)]
    rows = [(i, " ".join([*base[:19], f"x{i}"])) for i in range(30)]
    signatures = ld.Scratch.table(ld.line_signatures(corpus.frame(spark, rows), 80), "test-lines")
    lids = {r.doc_id: r.lid for r in signatures.collect()}
    settled = spark.createDataFrame([(lids[i],) for i in range(1, 28)], "lid long")
    pairs = {(r.lid1, r.lid2) for r in ld.candidate_pairs(signatures, settled, 80).collect()}
    open_lines = {lids[0], lids[28], lids[29]}
    assert pairs and all({a, b} & open_lines for a, b in pairs)
    want = {(min(lids[i], lids[j]), max(lids[i], lids[j])) for j in (28, 29) for i in range(j)}
    assert want <= pairs


def test_runs_go_before_the_texts_are_exchanged_again(spark, monkeypatch):
    """Of the tables between, only the removals are left when the result is made, with levels of merges and without."""
    text = "".join(f"word{i} " for i in range(40))
    docs = spark.createDataFrame([(i, f"{i} {text}") for i in range(12)], "doc_id long, text string")
    found = []
    for fanin in (256, 2):
        monkeypatch.setattr(suffixdedup, "FANIN", fanin)
        before = set(Scratch._alive)
        out = suffixdedup.remove_repeats(docs)
        assert {p.split("readloom-")[-1].rsplit("-", 1)[0] for p in set(Scratch._alive) - before} == {"suffix-removals"}
        found.append(sorted(map(tuple, out.collect())))
    assert found[0] == found[1] and [r[2] > 0 for r in found[0]] == [False] + [True] * 11
