"""WARC captures (9) and the pipeline."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import corpus
import pytest
from test_duplicates import lines_brute, near_brute, tokens
from test_models import base_counts, naive_posteriors

from readloom.llm import linededup, lshforest, mixing, quality, warc
from readloom.llm.queries import QUERIES
from readloom.sources import store

SCHEMA = "page_id long, url string, html string, type string, data string"


def pages(spark):
    big = "<p>" + "x" * 1500
    rows = [(1, "http://a", big), (2, "http://b", "y"), (3, None, big), (4, "http://d", None), (5, "http://e", "é" * 600), (6, "u\r\nX: 1", big), (7, "http://g", "y"), (8, "http://h", ""), (9, "http://i", "é" * 600), (10, "http://j", "z" * 999), (11, "http://k", "z" * 999)]
    return spark.createDataFrame([(*r, "t", "d") for r in rows], SCHEMA)


def archive_bytes(spark, folder):
    paths = sorted(r.path for r in warc.read_archives(spark, folder).collect())
    assert all(p.endswith(".warc.gz") for p in paths)
    return [store.read(p) for p in paths]


def members(data):
    """The plain bytes of each gzip member, by the standard library alone."""
    out = []
    while data:
        unpacker = zlib.decompressobj(31)
        out.append(unpacker.decompress(data))
        data = unpacker.unused_data
    return out


def test_captures(spark):
    df = pages(spark)
    got = {r.page_id: r for r in warc.page_captures(df).collect()}
    texts = {r.page_id: (r.html or "").encode() for r in df.collect()}
    assert len(got) == len(texts)
    for k, body in texts.items():
        twins = [j for j, b in texts.items() if b == body]
        revisit = len(body) >= 1000 and max(twins) != k
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", max(twins)) if revisit else ("response", None))
        assert r.n_requests == 1 and r.n_metadata == 1


def test_records_and_transactions(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1)
    monkeypatch.setattr(warc, "BUNDLES", 4)
    folder = warc.write_archives(pages(spark).coalesce(1))
    archives = archive_bytes(spark, folder)
    assert len(archives) == 3
    for data in archives:
        kinds = [h["warc-type"] for h, _ in warc.parse_records(data)]
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1 and len(kinds) in (13, 10)
        assert len(members(data)) == len(kinds)
    whole = b"".join(archives)
    plain = list(warc.parse_records(whole))
    assert len(plain) == 36 and {h["warc-type"] for h, _ in plain} == {"warcinfo", "request", "response", "revisit", "metadata"}
    ids = [h["warc-record-id"] for h, _ in plain]
    assert len(set(ids)) == len(ids)
    assert all(h["warc-refers-to"] in ids for h, _ in plain if h["warc-type"] == "revisit")
    # damage: a cut file loses its last record, a broken length only its own record
    assert len(list(warc.parse_records(whole[:-20]))) >= 23
    bare = warc.END.join(warc.capture_records(k, None, b"z", "d")[1] for k in (1, 2, 3))
    assert [h["x-capture-key"] for h, _ in warc.parse_records(bare.replace(b"Content-Length", b"Content-Lengtt", 1))] == ["2", "3"]
    made = spark.createDataFrame([(whole,), (None,), (b"junk",), (bare,)], "data binary")
    captures = warc.assemble(warc.read_records(made))
    one = captures.filter("response.capture_key = 2 and response.url = 'http://b'").first()
    assert captures.count() == 14 and one.request.block.startswith(b"GET http://b") and b"payloadBytes: 1" in one.metadata.block
    assert warc.http_payload(bytes(one.response.block)) == b"y"
    alone = warc.read_records(made).filter("type <> 'request'")
    assert warc.assemble(alone).filter("request is null and n_requests = 0").count() == 14


def test_empty_and_repeated_pages(spark):
    df = pages(spark)
    assert warc.page_captures(df.limit(0)).count() == 0
    twice = warc.page_captures(df.union(df.filter("page_id = 2"))).collect()
    assert len(twice) == 12 and [r.n_requests for r in twice if r.page_id == 2] == [1, 1]


def test_one_key_for_two_payloads_and_no_key(spark):
    one, two = "p" * 1200, "q" * 1300
    rows = [(5, "http://a", one), (5, "http://a", two), (9, "http://b", one), (None, "http://c", two), (None, "http://d", "x"), (None, "http://d", "x")]
    df = spark.createDataFrame([(*r, "t", "d") for r in rows], SCHEMA)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.page_captures(df).collect()))
    assert got == [(0, 1, "response", 0), (0, 1, "response", 0), (0, 1300, "revisit", 5), (5, 1200, "revisit", 9), (5, 1300, "response", 0), (9, 1200, "response", 0)]
    stored = [b for data in archive_bytes(spark, warc.write_archives(df)) for h, b in warc.parse_records(data) if h["warc-type"] == "response"]
    assert {warc.http_payload(b).decode() for b in stored} == {one, two, "x"}


def test_any_bytes(spark):
    data = bytes(range(256)) * 9 + b"\r\n\r\nWARC/1.1 \xff"
    df = spark.createDataFrame([(1, "u", data)], "page_id long, url string, html binary")
    r = warc.page_captures(df).first()
    assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())


def test_streams_of_any_cut(monkeypatch):
    """One member a record, one a file, members that cut records, plain files: the same records at any size of reads."""
    rng = random.Random(4)
    blocks = [b"GET /%d" % k + bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 40, 3000]))) for k in range(30)]
    records = [warc.record("request", {"WARC-Record-ID": str(k)}, b) + warc.END for k, b in enumerate(blocks)]
    plain = b"".join(records)
    single = [warc.member(r) for r in records]
    cut = b"".join(warc.member(plain[i : i + 700]) for i in range(0, len(plain), 700))
    forms = [plain, b"".join(single), gzip.compress(plain), cut, bytes(40).join(single) + warc.NOTHING]
    for chunk, feed in ((1 << 20, 1 << 14), (64, 16), (7, 5)):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        monkeypatch.setattr(warc, "FEED", feed)
        for form in forms:
            assert [b for _, b in warc.parse_records(form)] == blocks
        # a broken member and a broken length take only their own record with them
        hurt = bytearray(single[3])
        hurt[len(hurt) // 2 :] = bytes(len(hurt) - len(hurt) // 2)
        long = warc.member(records[5].replace(b"Content-Length: ", b"Content-Length: 9"))
        got = [b for _, b in warc.parse_records(b"".join([*single[:3], bytes(hurt), single[4], long, *single[6:]]))]
        assert got == blocks[:3] + blocks[4:5] + blocks[6:]
        assert [b for _, b in warc.parse_records(b"".join(single)[:-9])][:29] == blocks[:29]
    assert list(warc.parse_records(b"")) == [] == list(warc.parse_records(b"\x1f\x8b\x08junk"))


def test_memory_is_that_of_a_record(spark, monkeypatch):
    """Many captures to a file: what a reader holds at once stays near one record's size."""
    import tracemalloc

    monkeypatch.setattr(warc, "CHUNK", 1 << 14)
    body = bytes(range(256)) * 400
    whole = b"".join(warc.member(r + warc.END) for k in range(300) for r in warc.capture_records(k, "u", body + b"%d" % k, "d"))
    file = io.BytesIO(whole)
    tracemalloc.start()
    n = sum(len(b) for _, b in warc.records_of(warc.plain_pieces(file.read)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 300 * len(body) and peak < 12 * len(body)


def test_members_over_16_mb(spark, monkeypatch):
    """A record whose member does not end in a zero byte is followed by the member of nothing."""
    df = spark.createDataFrame([(1, "u", "ab" * (9 << 20)), (2, "v", "x")], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.page_captures(df).collect()) == [(1, 18 << 20), (2, 1)]


def test_stages_against_operators(spark):
    """Each stage on what its predecessor kept, compared with the operators' own verdicts."""
    import corpus_pipeline as cp

    docs = corpus.awkward(spark).drop("size", "kept", "words", "bucket", "id")
    columns = docs.columns
    kept = {r.doc_id for r in quality.assess_quality(docs).filter("kept").collect()}
    stage = dict(cp.STAGES)
    assert list(stage) == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mix_sources", "byte_level_bpe"]
    one = stage["quality_rules"](spark, docs, "").collect()
    assert {r.doc_id for r in one} == kept
    docs = spark.createDataFrame(one, docs.schema)
    two = stage["line_dedup"](spark, docs, "").collect()
    verdicts = {r.doc_id: r for r in linededup.line_verdicts(docs).collect()}
    assert {r.doc_id for r in two} == {i for i, v in verdicts.items() if v.n_removed < v.n_lines}
    docs = spark.createDataFrame(two, docs.schema)
    three = stage["ngram_jaccard_join"](spark, docs, "").collect()
    classes = {r.doc_id: r.class_id for r in lshforest.near_duplicates(docs).collect()}
    assert {r.doc_id for r in three if r.doc_id is not None} == set(classes.values())
    docs = spark.createDataFrame(three, docs.schema)
    four = stage["mix_sources"](spark, docs, "").collect()
    passes = [r.passes for r in mixing.mix(docs).collect()]
    assert len(four) == sum(passes)
    docs = spark.createDataFrame(four, docs.schema)
    assert docs.columns == columns
    five = stage["byte_level_bpe"](spark, docs, "").collect()
    assert len(five) == len(four) and all(r.n_tokens > 0 for r in five)


def naive_mix(rows):
    """(doc_id, text, source) rows in the order of service, one by one in plain Python."""
    size = {r: len(tokens(r[1])) for r in rows}
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    total = sum(size.values())
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    whole = {s: sum(n for r, n in size.items() if r[2] == s) for s in sources}
    items = []
    for s in sources:
        done = 0
        for h, r in sorted((hashlib.md5(f"17:{r[0]}:{r[1]}".encode()).hexdigest(), r) for r in rows if r[2] == s):
            done += size[r]
            items += [((k * whole[s] + done) / weight[s], h, k, r) for k in range(3) if size[r]]
    out, used = [], 0
    for *_, r in sorted(items, key=lambda x: x[:3]):
        used += size[r]
        if used > total:
            break
        out.append(r)
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """The whole run on a small corpus of its own documents, against plain Python from end to end."""
    import tiktoken

    import corpus_pipeline as cp
    from readloom.llm import bpe

    rng = random.Random(21)
    texts = [corpus.words(rng, rng.randrange(60, 90), 4000) + "\n" + corpus.words(rng, rng.randrange(8, 30), 4000) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", texts[2].split("\n")[0] + "\n" + corpus.words(rng, 20, 4000), "short text", "", None, "again and again " * 60]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    votes = {r[0]: quality.pattern(quality.RULES, quality.measure((r[1] or "").encode())) for r in rows}
    posterior = naive_posteriors(Counter(votes.values()), len(quality.RULES))
    kept = []
    for i, t, _, s, _ in rows:
        n = base_counts(t)
        if n[0] >= 50 and 2 * n[4] <= n[0] and posterior[votes[i]] >= 0.5:
            kept.append((i, t, s))
    lines, gone = lines_brute([r[:2] for r in kept])
    deduped = []
    for i, t, s in kept:
        own = [x[1] for x in lines if x[0] == i]
        if not own or any((i, j) not in gone for j in own):
            deduped.append((i, "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone), s))
    classes = near_brute([r[:2] for r in deduped])
    single = [r for r in deduped if r[0] not in classes or classes[r[0]][0] == r[0]]
    mixed = naive_mix(single)
    assert len(rows) > len(kept) >= len(deduped) >= len(single) > 30 and len(mixed) > len(set(mixed))
    own = bpe.encoder(*bpe.vocabulary())
    library = tiktoken.Encoding("t", pat_str=bpe.vocabulary()[1], mergeable_ranks=own.ranks, special_tokens={})
    want = Counter((i, hashlib.sha256(",".join(map(str, library.encode_ordinary(t))).encode()).hexdigest()) for i, t, _ in mixed)
    assert Counter((r.doc_id, r.ids_sha256) for r in cp.run(spark, str(tmp_path)).collect()) == want


def test_run(spark):
    import corpus_pipeline as cp

    rows = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and cp.ORACLE_SQL is None


@pytest.mark.parametrize("number", range(1, 11))
def test_registered(number):
    assert sum(name.startswith(f"op{number}_") for name in QUERIES) == 1
