"""MPEG transport streams as a media column: program tables, continuity, elementary packets, random-access points.

``demux`` parses any byte string as packets of 188 bytes: it finds the program association and program map tables
(checking their CRC), follows each elementary stream's continuity counter, reassembles packetised elementary packets
and lists their timestamps and random-access flags. ``mux`` writes one program with one private data stream, which is
how arbitrary bytes are stored losslessly.

Defined cases: null counts as empty; an empty text is padded to 64 zero bytes, so every stream has an access unit;
very long payloads become more access units; bytes out of sync are skipped and counted; duplicate packets are dropped;
a gap in a continuity counter is counted and ends the packet under way, unless the stream announces it; tables may
span packets and follow one another, those with a bad CRC or a gap are ignored and counted, and those that do not hold
yet are passed over; a newer version of a program map ends the streams that it leaves out; extra columns are kept out
of the result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .runtime import Scratch, prepare

PACKET = 188
SYNC = 0x47
#: Private data stream, its stream_id and the identifiers that ``mux`` uses.
PRIVATE_TYPE, PRIVATE_ID = 0x06, 0xBD
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT = 8192
CLOCK = 90_000
UNIT_TICKS = CLOCK // 25
ALIGN = 64
#: Media bytes behind one batch of rows.
OUT_BYTES = 4 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC_TABLE[c >> 24 ^ b]
    return c


# -- writing ----------------------------------------------------------------------------------------------------------


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


@lru_cache(1)
def _tables() -> bytes:
    pat = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(0x02, PROGRAM, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000))
    return _table_packet(0, pat) + _table_packet(PMT_PID, pmt)


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | ticks >> 29 & 0x0E | 1, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """One program, one private stream; an access unit every ``unit`` bytes, each a random-access point with PTS and PCR."""
    out = [_tables()]
    counter = 0
    plain = [struct.pack(">BHB", SYNC, DATA_PID, 0x10 | c) for c in range(16)]
    for n, at in enumerate(range(0, len(payload), unit)):
        ticks = n * UNIT_TICKS & (1 << 33) - 1
        body = payload[at : at + unit]
        pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_ID, len(body) + 8, 0x84, 0x80, 5) + _stamp(2, ticks) + body
        # First packet: adaptation field with the random-access flag and the clock.
        room = PACKET - 4 - 8
        first = pes[:room]
        stuffing = room - len(first)
        clock = struct.pack(">Q", ticks << 15 | 0x7E00)[2:]
        out.append(struct.pack(">BHBBB", SYNC, 0x4000 | DATA_PID, 0x30 | counter, 7 + stuffing, 0x50) + clock + b"\xff" * stuffing + first)
        counter = counter + 1 & 15
        whole = (len(pes) - len(first)) // (PACKET - 4)
        end = len(first) + whole * (PACKET - 4)
        for i in range(len(first), end, PACKET - 4):
            out.append(plain[counter])
            out.append(pes[i : i + PACKET - 4])
            counter = counter + 1 & 15
        if rest := pes[end:]:
            gap = PACKET - 4 - len(rest)
            field_ = bytes([gap - 1]) + (b"\0" + b"\xff" * (gap - 2) if gap > 1 else b"")
            out.append(struct.pack(">BHB", SYNC, DATA_PID, 0x30 | counter) + field_ + rest)
            counter = counter + 1 & 15
    return b"".join(out)


# -- reading ----------------------------------------------------------------------------------------------------------


@dataclass
class ElementaryPacket:
    pid: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    offset: int
    data: bytes


@dataclass
class _Stream:
    counter: int = -1
    last: bytes = b""
    parts: list[bytes] | None = None
    offset: int = 0
    random_access: bool = False


@dataclass
class TransportStream:
    """What a demultiplexed stream holds. streams: stream type by PID; programs: PMT's PID by program number."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: list[ElementaryPacket] = field(default_factory=list)
    clocks: int = 0
    n_packets: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    skipped_bytes: int = 0
    bad_tables: int = 0

    def payload(self, pid: int) -> bytes:
        return b"".join([p.data for p in self.packets if p.pid == pid])


@lru_cache(4096)
def _parse_section(section: bytes) -> tuple[int, bool, tuple[tuple[int, int], ...], int, int] | None:
    """Table, whether it holds now, (program, PMT PID) of an association table or (PID, type) of a map table, the number
    of the stream or program that it is about, and its version.

    None if damaged; other tables have no entries.
    """
    if len(section) < 12 or crc32_mpeg(section) != 0:
        return None
    table, out, at, end = section[0], [], 8, len(section) - 4
    if table == 2:
        at += 4 + (struct.unpack_from(">H", section, 10)[0] & 0xFFF)
    while table in (0, 2) and at + (4 if table == 0 else 5) <= end:
        if table == 0:
            number, pid = struct.unpack_from(">HH", section, at)
            out.append((number, pid & 0x1FFF))
            at += 4
        else:
            kind, pid, info = struct.unpack_from(">BHH", section, at)
            out.append((pid & 0x1FFF, kind))
            at += 5 + (info & 0xFFF)
    return table, bool(section[5] & 1), tuple(out), section[3] << 8 | section[4], section[5] >> 1 & 31


@dataclass
class _Sections:
    """Sections of one PID: they begin at a pointer, follow one another and go on in the packets that come next."""

    counter: int = -1
    last: bytes = b""
    rest: bytes | None = None

    def feed(self, ts: TransportStream, start: bool, counter: int, body: bytes, jump: bool) -> Iterator[bytes]:
        if counter == self.counter and body == self.last and not jump:
            ts.duplicates += 1
            return
        if self.counter >= 0 and counter != self.counter + 1 & 15 and not jump:
            ts.continuity_errors += 1
            self._lose(ts)
        self.counter, self.last = counter, body
        if start:
            begin = 1 + body[0]
            if self.rest is not None:
                self.rest += body[1:begin]
                yield from self._whole(ts)
                self._lose(ts)
            self.rest = body[begin:]
        elif self.rest is not None:
            self.rest += body
        else:
            return
        yield from self._whole(ts)

    def _whole(self, ts: TransportStream) -> Iterator[bytes]:
        while self.rest:
            if self.rest[0] == 0xFF:  # stuffing up to the next pointer
                self.rest = None
                return
            if len(self.rest) < 3 or len(self.rest) < (size := 3 + (struct.unpack_from(">H", self.rest, 1)[0] & 0xFFF)):
                return
            yield self.rest[:size]
            self.rest = self.rest[size:]

    def _lose(self, ts: TransportStream) -> None:
        if self.rest:
            ts.bad_tables += 1
        self.rest = None


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _finish(ts: TransportStream, pid: int, s: _Stream) -> None:
    """Close the elementary packet under way on a stream."""
    if s.parts is None:
        return
    pes = b"".join(s.parts)
    s.parts = None
    if len(pes) < 6 or pes[:3] != b"\0\0\1":
        ts.continuity_errors += 1
        return
    length = pes[4] << 8 | pes[5]
    if length:
        if len(pes) < 6 + length:
            ts.continuity_errors += 1  # cut short
        pes = pes[: 6 + length]
    start, pts, dts = 6, None, None
    if len(pes) >= 9 and pes[6] >> 6 == 2:
        flags, start = pes[7], 9 + pes[8]
        if flags & 0x80 and len(pes) >= 14:
            pts = _ticks(pes[9:14])
        if flags & 0xC0 == 0xC0 and len(pes) >= 19:
            dts = _ticks(pes[14:19])
    ts.packets.append(ElementaryPacket(pid, pes[3], pts, dts, s.random_access, s.offset, pes[start:]))


def demux(media: bytes) -> TransportStream:
    """Parse a transport stream; damage is counted and never raises."""
    ts = TransportStream()
    open_streams: dict[int, _Stream] = {}
    maps: set[int] = set()
    tables: dict[int, _Sections] = {}
    versions: dict[tuple[int, int], tuple[int, set[int]]] = {}
    at, end = 0, len(media)
    while at < end:
        if end - at < PACKET or media[at] != SYNC or (at + PACKET < end and media[at + PACKET] != SYNC):
            # Out of sync: go to the next sync byte that another one follows a packet later.
            to = media.find(SYNC, at + 1)
            while to != -1 and not (to + PACKET == end or (to + PACKET < end and media[to + PACKET] == SYNC)):
                to = media.find(SYNC, to + 1)
            to = end if to == -1 else to
            ts.skipped_bytes += to - at
            at = to
            continue
        head = media[at + 1] << 8 | media[at + 2]
        control, pid = media[at + 3], head & 0x1FFF
        offset, begin = at, at + 4
        at += PACKET
        ts.n_packets += 1
        random_access = jump = False
        if control & 0x20:
            size = media[begin]
            if size:
                jump = bool(media[begin + 1] & 0x80)  # a discontinuity that the sender announces
                random_access = bool(media[begin + 1] & 0x40)
                ts.clocks += media[begin + 1] >> 4 & 1
            begin += 1 + size
        if head & 0x8000 or pid == 0x1FFF or not control & 0x10 or begin >= at:
            continue
        body = media[begin:at]
        if pid == 0 or pid in maps:
            wanted = 0 if pid == 0 else 2
            for section in tables.setdefault(pid, _Sections()).feed(ts, bool(head & 0x4000), control & 15, body, jump):
                found = _parse_section(section)
                if found is None:
                    ts.bad_tables += 1
                elif found[0] != wanted or not found[1]:
                    continue  # another table, or one that will hold later
                elif pid == 0:
                    ts.programs.update((n, p) for n, p in found[2] if n)
                    maps.update(p for n, p in found[2] if n)
                else:
                    named = {p for p, _ in found[2]}
                    version, known = versions.get((pid, found[3]), (found[4], set()))
                    if version == found[4]:
                        named |= known
                    for p in known - named:  # streams that a newer version leaves out
                        ts.streams.pop(p, None)
                        if (gone := open_streams.pop(p, None)) is not None:
                            _finish(ts, p, gone)
                    versions[pid, found[3]] = found[4], named
                    ts.streams.update(found[2])
                    for p, _ in found[2]:
                        open_streams.setdefault(p, _Stream())
            continue
        s = open_streams.get(pid)
        if s is None:
            continue
        counter = control & 15
        if s.counter == counter and s.last == body and not jump:
            ts.duplicates += 1
            continue
        if s.counter >= 0 and counter != s.counter + 1 & 15 and not jump:
            ts.continuity_errors += 1
            if not head & 0x4000:
                _finish(ts, pid, s)
        s.counter, s.last = counter, body
        if head & 0x4000:
            _finish(ts, pid, s)
            s.parts, s.offset, s.random_access = [body], offset, random_access
        elif s.parts is not None:
            s.parts.append(body)
    for pid, s in open_streams.items():
        _finish(ts, pid, s)
    return ts


# -- columns ----------------------------------------------------------------------------------------------------------

I32, I64 = pa.int32(), pa.int64()
COUNTERS = ("n_packets", "continuity_errors", "duplicates", "skipped_bytes", "bad_tables")
#: Of ``index_media``: one nested row per media value.
INDEX = (
    *((c, I64) for c in COUNTERS),
    ("programs", pa.list_(pa.struct([("program", I32), ("pmt_pid", I32)]))),
    ("streams", pa.list_(pa.struct([("pid", I32), ("stream_type", I32)]))),
    ("units", pa.list_(pa.struct([("pid", I32), ("stream_id", I32), ("pts", I64), ("dts", I64), ("random_access", pa.bool_()), ("offset", I64), ("size", I64)]))),
)
#: Of ``media_report``, besides the key, the bytes of the text and INDEX.
DIGEST = (("payload_bytes", I64), ("payload_sha256", pa.string()), ("tail_crc32", I64), ("media_bytes", I64), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_units", I64))


def index_row(ts: TransportStream) -> dict[str, object]:
    """The values of INDEX."""
    units = [{"pid": p.pid, "stream_id": p.stream_id, "pts": p.pts, "dts": p.dts, "random_access": p.random_access, "offset": p.offset, "size": len(p.data)} for p in ts.packets]
    programs = [{"program": a, "pmt_pid": b} for a, b in sorted(ts.programs.items())]
    streams = [{"pid": a, "stream_type": b} for a, b in sorted(ts.streams.items())]
    return {**{c: getattr(ts, c) for c in COUNTERS}, "programs": programs, "streams": streams, "units": units}


def digest_row(media: bytes, ts: TransportStream) -> dict[str, object]:
    """The values of DIGEST."""
    payload = ts.payload(DATA_PID)
    access = [p.pts for p in ts.packets if p.random_access]
    feature = {
        "programs": ts.programs, "streams": ts.streams, "packets": ts.n_packets, "units": len(ts.packets), "random_access": len(access),
        "first_pts": access[0] if access else None, "last_pts": access[-1] if access else None, "clocks": ts.clocks, "continuity_errors": ts.continuity_errors,
        "index_crc32": zlib.crc32(struct.pack(f">{2 * len(ts.packets)}Q", *(x for p in ts.packets for x in (p.pts or 0, p.offset)))),
    }
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-ALIGN:]), "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(), "feature": json.dumps(feature, separators=(",", ":")), "n_units": len(ts.packets),
    }


def _each(table: DataFrame, kept: list[str], column: str, fields: tuple, row_of: Callable[[bytes], dict[str, object]]) -> DataFrame:
    """The kept columns (whole numbers) of table and the fields that row_of makes of each value of a binary column (null:
    empty). Rows go out in batches of so many media bytes."""
    prepare(table.sparkSession)
    schema = pa.schema([*((c, I64) for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for *own, media in zip(*batch.columns, strict=True):
                media = media.as_py() or b""
                rows.append({**{c: v.as_py() for c, v in zip(kept, own, strict=True)}, **row_of(media)})
                size += len(media)
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    shape = from_arrow_schema(schema)
    return table.select(*[F.col(c).cast("long").alias(c) for c in kept], F.col(column).cast("binary").alias(column)).mapInArrow(run, shape)


def index_media(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key and the tables, counters, timestamps and random-access points of each transport stream (null: empty)."""
    return _each(media, [key], column, INDEX, lambda m: index_row(demux(m)))


def media_report(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the digests of a stored text's stream and of what it holds, and its index (nested)."""

    def row_of(m: bytes) -> dict[str, object]:
        ts = demux(m)
        return {**digest_row(m, ts), **index_row(ts)}

    return _each(media, ["doc_id", "n_bytes"], "media", (*DIGEST, *INDEX), row_of)


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of 64."""
    return data.ljust(max(ALIGN, -(-len(data) // ALIGN) * ALIGN), b"\0")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and the transport stream (media) that holds each text's bytes."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = docs.select("doc_id", F.octet_length(data).alias("n_bytes"), data.alias("data"))
    return _each(texts, ["doc_id", "n_bytes"], "data", (("media", pa.binary()),), lambda t: {"media": mux(padded(t))})


def text_round_trip(docs: DataFrame) -> DataFrame:
    """Store every text in a table with a media column, read the stored bytes back, and describe what was found.

    The table lies in the shared folder until the driver ends.
    """
    return media_report(Scratch.table(store_texts(docs), "media"))
