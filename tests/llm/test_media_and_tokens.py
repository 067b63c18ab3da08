"""Transport streams (1) and byte-level BPE (6)."""

import hashlib
import random
import struct
import zlib

import corpus
import pytest
import tiktoken

from readloom.llm import bpe, mpegts


@pytest.mark.parametrize("n", [0, 1, 64, 169, 170, 171, 184, 353, 354, 8192, 8193, 70_000])
def test_round_trip(n):
    data = mpegts.padded(random.Random(n).randbytes(n))
    ts = mpegts.demux(mpegts.mux(data))
    assert ts.payload(mpegts.DATA_PID) == data and len(data) % 64 == 0 and len(data) >= 64
    assert ts.programs == {1: mpegts.PMT_PID} and ts.streams == {mpegts.DATA_PID: 6}
    assert not (ts.continuity_errors or ts.skipped_bytes or ts.bad_tables or ts.duplicates)
    assert all(p.random_access for p in ts.packets)
    assert [p.pts for p in ts.packets] == [i * mpegts.UNIT_TICKS for i in range(len(ts.packets))]


def test_damage_is_counted():
    media = mpegts.mux(b"q" * 5000)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    lost = mpegts.demux(b"".join(packets[:6] + packets[7:]))
    assert lost.continuity_errors >= 1
    assert mpegts.demux(b"".join(packets[:6] + [packets[5]] + packets[6:])).duplicates == 1
    noise = mpegts.demux(b"noise" + media)
    assert noise.skipped_bytes == 5 and noise.payload(mpegts.DATA_PID) == b"q" * 5000
    broken = bytearray(media)
    broken[10] ^= 1
    assert mpegts.demux(bytes(broken)).bad_tables == 1
    assert mpegts.demux(b"").n_packets == 0 and mpegts.demux(b"\x47" * 50).n_packets == 0


def packets(pid, section, counter=0):
    """A section in as many packets as it takes."""
    data, out, first = b"\0" + section, [], True
    while data:
        out.append((bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 0xFF, 0x10 | counter]) + data[:184]).ljust(188, b"\xff"))
        data, first, counter = data[184:], False, counter + 1 & 15
    return out


def program_map(n, number=1, now=1):
    body = b"\xe1\x00\xf0\x00" + b"".join(bytes([6, 0xE0 | (0x200 + i) >> 8, (0x200 + i) & 0xFF, 0xF0, 0]) for i in range(n))
    head = bytes([2, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, 0, number, 0xC0 | now, 0, 0]) + body
    return head + mpegts.crc32_mpeg(head).to_bytes(4, "big")


def test_tables_over_several_packets():
    pat = mpegts.mux(b"")[:188]
    section = program_map(60)
    assert len(section) == 316
    whole = packets(mpegts.PMT_PID, section)
    ts = mpegts.demux(pat + b"".join(whole))
    assert len(whole) == 2 and len(ts.streams) == 60 and not ts.bad_tables and not ts.continuity_errors
    # other packets between, a packet sent twice, a gap, a table that holds later, two sections in one packet
    assert len(mpegts.demux(pat + whole[0] + pat + whole[1]).streams) == 60
    assert mpegts.demux(pat + whole[0] + whole[0] + whole[1]).duplicates == 1
    lost = packets(mpegts.PMT_PID, program_map(100))
    lost = mpegts.demux(pat + lost[0] + lost[2])
    assert not lost.streams and lost.continuity_errors == 1 and lost.bad_tables == 1
    assert not mpegts.demux(pat + b"".join(packets(mpegts.PMT_PID, program_map(3, now=0)))).streams
    assert len(mpegts.demux(pat + b"".join(packets(mpegts.PMT_PID, program_map(3) + program_map(5)))).streams) == 5


def test_announced_discontinuity():
    media = mpegts.mux(b"q" * 9000)
    units = [i for i in range(0, len(media), 188) if media[i + 1] & 0x40 and media[i + 2] == 0 and media[i + 1] & 0x1F == 1]
    jumped = bytearray(media)
    for i in range(units[1], len(media), 188):
        jumped[i + 3] = jumped[i + 3] & 0xF0 | (jumped[i + 3] + 5) & 15
    assert mpegts.demux(bytes(jumped)).continuity_errors == 1
    jumped[units[1] + 5] |= 0x80
    assert mpegts.demux(bytes(jumped)).continuity_errors == 0


def test_newer_map_ends_streams():
    """A map of a newer version replaces the one before; packets of streams that it leaves out are no longer followed."""
    media = mpegts.mux(b"q" * 9000)
    pat, pmt, data = media[:188], media[188:376], media[376:]
    other = mpegts._section(0x02, mpegts.PROGRAM, struct.pack(">HH", 0xE101, 0xF000) + struct.pack(">BHH", 6, 0xE101, 0xF000))
    newer = other[:5] + bytes([other[5] + 2]) + other[6:-4]
    newer = bytearray(mpegts._table_packet(mpegts.PMT_PID, newer + struct.pack(">I", mpegts.crc32_mpeg(newer))))
    newer[3] = newer[3] & 0xF0 | 1
    half = len(data) // 188 // 2 * 188
    ts = mpegts.demux(pat + pmt + data[:half] + bytes(newer) + data[half:])
    assert ts.streams == {0x101: 6} and not ts.bad_tables
    whole = mpegts.demux(media)
    assert len(whole.packets) == 2 and len(ts.packets) == 1 and len(ts.packets[0].data) < 8192
    again = bytearray(pmt)
    again[3] = again[3] & 0xF0 | 1
    assert mpegts.demux(pat + pmt + data[:half] + bytes(again) + data[half:]).payload(mpegts.DATA_PID) == whole.payload(mpegts.DATA_PID)


def test_text_columns(spark):
    docs = corpus.awkward(spark)
    rows = mpegts.text_round_trip(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        raw = (texts[r.doc_id] or "").encode()
        stored = mpegts.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))
        access = range(0, len(stored), mpegts.UNIT)
        assert [(u.pts, u.random_access, u.size) for u in r.units] == [(i * mpegts.UNIT_TICKS, True, len(stored[b : b + mpegts.UNIT])) for i, b in enumerate(access)]
        assert [tuple(x) for x in r.streams] == [(mpegts.DATA_PID, mpegts.PRIVATE_TYPE)] and r.continuity_errors == 0
    by_text = {}
    for r in rows:
        by_text.setdefault(texts.get(r.doc_id), set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for k, v in by_text.items() if k)
    index = mpegts.index_media(mpegts.store_texts(docs).withColumnsRenamed({"doc_id": "k", "media": "m"}), "k", "m")
    first = index.filter("k = 0").first()
    assert first.units == next(r for r in rows if r.doc_id == 0).units and first.units[0].random_access
    # any seek lands on a stored offset: the packet there carries the unit's start
    media = bytes(mpegts.store_texts(docs).filter("n_bytes > 100000").first().media)
    units = mpegts.demux(media).packets
    assert len(units) > 12 and all(media[u.offset] == mpegts.SYNC and media[u.offset + 1] & 0x40 for u in units)
    assert mpegts.text_round_trip(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoders():
    path, pattern = bpe.vocabulary()
    own = bpe.encoder(path, pattern)
    return own, tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})


def test_equals_library(encoders):
    own, library = encoders
    rng = random.Random(3)
    texts = [t for _, t in corpus.documents() if t is not None]
    for _ in range(400):
        texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(33), 0x1F600, 0x2028, 0x85])) for _ in range(rng.randrange(80))))
        texts.append("".join(rng.choice("ab  c\n'st") for _ in range(100)))
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_backtracking_equals_merges(encoders):
    own, _ = encoders
    rng = random.Random(5)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdetionhs") for _ in range(rng.randrange(1, 60)))
        if piece not in own.ranks:
            assert list(own.encode_piece(piece)) == own.merged(piece)


def test_other_pattern_has_no_shortcut(encoders):
    path, _ = bpe.vocabulary()
    whole = bpe.BytePairEncoder(path, r"(?s).+")
    assert not whole.spaced and whole.decode(whole.encode("a b c")) == b"a b c"


def test_documents(spark, encoders):
    _, library = encoders
    docs = corpus.awkward(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode_documents(docs, with_ids=True).collect():
        if r.doc_id is not None:
            want = library.encode_ordinary(texts[r.doc_id] or "")
            assert r.ids == want and r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0)).count() == 0
