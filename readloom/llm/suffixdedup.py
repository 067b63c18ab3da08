"""Removal of repeated byte strings by a distributed merge sort of sparse suffixes.

Every byte that a string of ``LENGTH`` bytes covers goes if that string also starts earlier (by doc_id, then start).
Sorting all suffixes is not needed: the least hash among the ``GRAM``-byte grams of a window of LENGTH bytes depends on
the window's bytes only, so equal windows agree in it. A stretch of windows with one least hash becomes one string,
sorted under that hash; a stretch whose hash occurs once in the corpus has no equal window and is left out.

The strings are sorted in runs, one per bucket of documents, front-coded (length of the prefix shared with the string
before, and the rest), exchanged by range of their first bytes, which are a hash and thus even, and merged by a loser
tree that knows what each run shares with the last string put out, so it compares no byte of a known prefix again.
Equal strings come out side by side; all but the earliest are removed whole. Within one hash different strings are
compared window by window. A hash that occurs more than ``HOT`` times is split: each of its windows becomes a string
under a hash of its own, so no range holds a hot group.

Defined cases: null and short texts lose nothing; very long texts are one stretch list like others; matches inside one
text count, also overlapping ones; rows that repeat doc_id and text get one verdict (none is earlier than the other);
rows with one doc_id and different texts are ordered by a hash of the text; a null doc_id comes first; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, gram_hashes, mix64, sliding_min
from .runtime import Scratch, prepare

LENGTH = 100
GRAM = 32
#: Occurrences of a hash from which on its windows are dealt out one by one.
HOT = 100_000
#: Bound on the number of such hashes (each byte starts one gram): they are sent to all tasks.
HOT_HASHES = 1_000_000
#: Text in a bucket, and strings expected in a range.
BUCKET_BYTES = 8 << 20
RANGE_STRINGS = 150_000
#: Ranges that hashes are dealt to in one exchange, and entries that a task between two exchanges holds.
STEP = 1024
RELAYED = 2_000_000
#: Runs merged at once.
FANIN = 256
#: Windows looked at together within one hash; more are handled in several passes.
WINDOWS = 1_000_000
CHUNK = 1 << 15


def window_minima(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(least gram hash of each window, hashes at all places that are least in some window). In chunks that stay in cache."""
    n = len(text) - length + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, U)
    data = np.frombuffer(text, np.uint8)
    grams = length - gram + 1
    h = np.concatenate([gram_hashes(data[at : at + CHUNK + gram - 1], gram) for at in range(0, len(data) - gram + 1, CHUNK)])
    least = np.concatenate([sliding_min(h[at : at + CHUNK + grams - 1], grams) for at in range(0, n, CHUNK)])
    pad = np.full(grams - 1, U(0xFFFFFFFFFFFFFFFF))
    inverse = ~np.concatenate([~pad, least, ~pad])
    greatest = np.concatenate([~sliding_min(inverse[at : at + CHUNK + grams - 1], grams) for at in range(0, len(h), CHUNK)])
    # Least hashes are small: mixed again they spread evenly over the ranges.
    return mix64(least), mix64(h[greatest[: len(h)] == h])


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    raw = struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, *types: str | None) -> list:
    (size,) = struct.unpack_from("<Q", blob)
    raw = pa.decompress(blob[8:], size, "zstd", asbytes=True)
    sizes, at, out = struct.unpack_from(f"<{len(types)}Q", raw), 8 * len(types), []
    for n, t in zip(sizes, types, strict=True):
        out.append(raw[at : at + n] if t is None else np.frombuffer(raw[at : at + n], t))
        at += n
    return out


# -- which hashes occur more than once --------------------------------------------------------------------------------

DEALT = "range bigint, blob binary"


def _occurrences(batches: Iterator[pa.RecordBatch], ranges: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (range, blob): low hash bits, buckets and counts of a batch's gram hashes, by ``width`` hash ranges.

    A hash found in several buckets of the batch is already known to repeat: one of its entries goes to its range, the
    others (count 0: pass on) to ranges by bucket, so a hot hash takes one entry per batch in its range.
    """
    for batch in batches:
        hashes, owners = [], []
        for bucket, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = window_minima(text)[1]
            hashes.append(found)
            owners.append(np.full(len(found), bucket, np.int64))
        if not hashes or not sum(map(len, hashes)):
            continue
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        h, owner, count = _counted(h, owner, np.ones(len(h), np.int64))
        yield _dealt(h, owner, count, np.where(count > 0, _range_of(h, ranges), owner % ranges), width)


def _counted(h: np.ndarray, owner: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per hash and bucket: the hash's first one has all its counts, the others 0."""
    order = np.lexsort((owner, h))
    h, owner, count = h[order], owner[order], count[order]
    new_hash = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_hash | np.concatenate([[True], owner[1:] != owner[:-1]])
    total = np.minimum(np.add.reduceat(count, np.flatnonzero(new_hash)), 0xFFFFFFFF)
    h, owner, first = h[new], owner[new], new_hash[new]
    return h, owner, np.where(first, total[np.cumsum(first) - 1], 0)


def _dealt(h: np.ndarray, owner: np.ndarray, count: np.ndarray, to: np.ndarray, width: int) -> pa.RecordBatch:
    to = to // width
    order = np.argsort(to, kind="stable")
    to, h, owner, count = to[order], h[order], owner[order], count[order]
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    ends = np.append(at[1:], len(to))
    blobs = [_pack(h[a:b], owner[a:b].astype(np.uint32), count[a:b].astype(np.uint32)) for a, b in zip(at, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(to[at], pa.int64()), pa.array(blobs, pa.binary())], ["range", "blob"])


def _relayed(batches: Iterator[pa.RecordBatch], ranges: int, wide: int, width: int) -> Iterator[pa.RecordBatch]:
    """Entries of ``wide`` ranges at a time, come sorted by those, dealt again by ``width`` of them.

    Entries of many batches meet here, so that blobs stay large, and a hot hash goes on as one counted entry in place of
    one per batch. Entries that need no count (0) go to any range of their group.
    """
    key, parts, held = None, [], 0

    def cut() -> pa.RecordBatch:
        h, owner, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
        owner, count, known = owner.astype(np.int64), count.astype(np.int64), count == 0
        passed = h[known], owner[known]
        h, owner, count = _counted(h[~known], owner[~known], count[~known]) if not known.all() else (h[:0], owner[:0], count[:0])
        h, owner, count = np.concatenate([h, passed[0]]), np.concatenate([owner, passed[1]]), np.concatenate([count, np.zeros(len(passed[0]), np.int64)])
        to = np.where(count > 0, _range_of(h, ranges), np.minimum(key * wide + owner % wide, ranges - 1))
        return _dealt(h, owner, count, to, width)

    for batch in batches:
        for group, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if parts and (group != key or held >= RELAYED):
                yield cut()
                parts, held = [], 0
            key = group
            parts.append(_unpack(blob, "u8", "u4", "u4"))
            held += len(parts[-1][0])
    if parts:
        yield cut()


def _steps(ranges: int) -> list[int]:
    """Ranges per group in each exchange: as few exchanges as deal to no more than STEP groups each, the last to ranges."""
    levels = 1
    while STEP**levels < ranges:
        levels += 1
    each = 1
    while each**levels < ranges:
        each += 1
    return [each**k for k in range(levels - 1, -1, -1)]


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _repeated(table: pa.Table, hot: int) -> pa.Table:
    """Rows (bucket, blob of its repeated hashes) of one hash range; bucket -1 has the hot hashes."""
    parts = [_unpack(b, "u8", "u4", "u4") for b in table.column("blob").to_pylist()]
    h, owner, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(h, kind="stable")
    h, owner, count = h[order], owner[order], count[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    total = np.add.reduceat(count, starts)
    passed = np.minimum.reduceat(count, starts) == 0
    many = h[starts][total > hot]
    total = np.repeat(np.where(passed, np.maximum(total, 2), total), np.diff(np.append(starts, len(h))))
    use = total > 1
    h, owner = h[use], owner[use].astype(np.int64)
    h, owner = np.concatenate([many, h]), np.concatenate([np.full(len(many), -1), owner])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if not len(h):
        return pa.table({"bucket": pa.array([], pa.int64()), "flags": pa.array([], pa.binary())})
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    ends = np.append(at[1:], len(owner))
    blobs = [_pack(h[a:b]) for a, b in zip(at, ends, strict=True)]
    return pa.table({"bucket": pa.array(owner[at], pa.int64()), "flags": pa.array(blobs, pa.binary())})


# -- sorted runs ------------------------------------------------------------------------------------------------------


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix; the first ``start`` bytes are known to agree."""
    most = min(len(a), len(b))
    step = 8
    while start < most:
        if a[start : start + step] == b[start : start + step]:
            start = min(most, start + step)
            step *= 2
        elif step == 1:
            return start
        else:
            step //= 2 if step <= 8 else 4
    return most


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared prefix lengths, rest lengths, rests) of sorted strings."""
    shared, rests, before = np.empty(len(strings), np.uint32), [], b""
    for i, s in enumerate(strings):
        n = shared_prefix(before, s)
        shared[i] = n
        rests.append(s[n:])
        before = s
    return shared, np.array([len(r) for r in rests], np.uint32), b"".join(rests)


def decode_run(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(prefix shared with the string before, string) in order."""
    s, at = b"", 0
    for n, length in zip(shared.tolist(), lengths.tolist(), strict=True):
        s = s[:n] + rests[at : at + length]
        at += length
        yield n, s


class LoserTree:
    """Merge of sorted runs of (shared prefix with the one before, string).

    A run's entry in the tree is its current string with the length of the prefix that it shares with the last string
    put out by the whole tree (at its own node: with the winner that beat it there). Of two entries the one that shares
    more is smaller; only at equal lengths are bytes compared, from that length on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.head: list[bytes | None] = [None] * self.size
        self.known = [0] * self.size
        for i, run in enumerate(runs):
            self.head[i] = next(run, (0, None))[1]
        self.loser = [0] * self.size
        winners = list(range(self.size))
        while len(winners) > 1:
            level = len(winners) // 2
            nxt = []
            for j in range(level):
                a, b = winners[2 * j], winners[2 * j + 1]
                w, lost = self._play(a, b)
                self.loser[level + j] = lost
                nxt.append(w)
            winners = nxt
        self.winner = winners[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one that it shares with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        known = self.known
        p, q = known[a], known[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        n = shared_prefix(x, y, p)
        # At equal strings the run of lower number goes first.
        if (len(x) == n and (len(y) > n or a < b)) or (len(x) > n and len(y) > n and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(prefix shared with the string before, string, run) in order."""
        head, known, loser, size = self.head, self.known, self.loser, self.size
        while (s := head[self.winner]) is not None:
            w = self.winner
            yield known[w], s, w
            n, head[w] = next(self.runs[w], (0, None))
            known[w] = n
            node = (w + size) // 2
            while node:
                w, loser[node] = self._play(w, loser[node])
                node //= 2
            self.winner = w


def _strings(text: bytes, hashes: np.ndarray, hot: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """(hash and bytes of a stretch of windows, its start) for the stretches whose hash repeats."""
    least, _ = window_minima(text)
    if not len(least) or not len(hashes):
        return
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    value = least[starts]
    ends = np.append(starts[1:], len(least))
    at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
    use = hashes[at] == value
    is_hot = np.isin(value, hot) if len(hot) else np.zeros(len(value), bool)
    for v, a, b, split in zip(value[use].astype(">u8"), starts[use].tolist(), ends[use].tolist(), is_hot[use].tolist(), strict=True):
        if split:
            for p in range(a, b):
                window = text[p : p + LENGTH]
                yield hashlib.blake2b(window, digest_size=8).digest() + window, p
        else:
            yield v.tobytes() + text[a : b + LENGTH - 1], a


ORDER = np.dtype([("id", "<i8"), ("th", "<i8"), ("start", "<u8"), ("bucket", "<u4"), ("doc", "<u4")])
RUNS = "range bigint, unit bigint, blob binary"


def _bucket_run(docs: pa.Table, flags: pa.Table, ranges: int, hot: np.ndarray) -> pa.Table:
    """One bucket's run, cut by range; strings that the bucket itself has earlier are settled here.

    Rows (range, unit, blob) hold a run of this bucket, rows with range -1 its settled removals (document number, start,
    end).
    """
    rows_out: list[tuple[int, int, bytes]] = []
    if docs.num_rows and flags.num_rows:
        bucket = docs.column("bucket")[0].as_py()
        hashes = np.unique(np.concatenate([_unpack(b, "u8")[0] for b in flags.column("flags").to_pylist()]))
        rows = sorted(zip(docs.column("id").to_pylist(), docs.column("th").to_pylist(), docs.column("text").to_pylist(), strict=True), key=lambda r: r[:2])
        entries, settled = [], []
        for number, (doc_id, th, text) in enumerate(rows):
            if number and rows[number - 1][:2] == (doc_id, th):
                continue  # a repeated row: its verdict is that of the first
            for s, start in _strings(text, hashes, hot):
                entries.append((s, number, start, doc_id, th))
        entries.sort(key=lambda e: e[0])  # stable: equal strings stay in order of document and start
        kept = []
        for e in entries:
            if kept and kept[-1][0] == e[0]:
                settled.append((e[1], e[2], e[2] + len(e[0]) - 8))
            else:
                kept.append(e)
        if settled:
            rows_out.append((-1, bucket, _pack(np.array(settled, np.int64))))
        order = np.array([(e[3], e[4], e[2], bucket, e[1]) for e in kept], ORDER)
        rows_out += _cut_run([e[0] for e in kept], order, ranges, bucket)
    return _rows(rows_out)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.table({"range": pa.array(columns[0], pa.int64()), "unit": pa.array(columns[1], pa.int64()), "blob": pa.array(columns[2], pa.binary())})


def _cut_run(strings: list[bytes], order: np.ndarray, ranges: int, unit: int) -> list[tuple[int, int, bytes]]:
    """A sorted run as front-coded pieces by range."""
    if not strings:
        return []
    to = _range_of(np.frombuffer(b"".join([s[:8] for s in strings]), ">u8").astype(U), ranges)
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    return [(int(to[a]), unit, _pack(*front_code(strings[a:b]), order[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(to)), strict=True)]


# -- merge ------------------------------------------------------------------------------------------------------------


class _Removals:
    """Removals (document number, start, end) by bucket."""

    def __init__(self):
        self.by_bucket: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, place: np.void, start: int, end: int) -> None:
        self.by_bucket.setdefault(int(place["bucket"]), []).append((int(place["doc"]), start, end))

    def rows(self) -> list[tuple[int, int, bytes]]:
        return [(-1, k, _pack(np.array(v, np.int64))) for k, v in sorted(self.by_bucket.items())]


def _distinct(table: pa.Table, removals: _Removals) -> Iterator[tuple[int, bytes, np.void]]:
    """(prefix shared with the string before, string, its earliest place) of the merged runs; later equal ones go."""
    runs, orders = [], []
    for blob in table.column("blob").to_pylist():
        shared, lengths, rests, order = _unpack(blob, "u4", "u4", None, None)
        runs.append(decode_run(shared, lengths, rests))
        orders.append(np.frombuffer(order, ORDER))
    cursor = [0] * len(runs)
    last = None
    for known, s, run in LoserTree(runs):
        place = orders[run][cursor[run]]
        cursor[run] += 1
        if last is not None and known == len(s) == len(last[1]):
            one, two = last[2], place
            key = lambda x: (x["id"], x["th"], x["start"])
            if key(two) < key(one):
                one, two = two, one
            if key(one) != key(two):
                removals.add(two, int(two["start"]), int(two["start"]) + len(s) - 8)
            last = (last[0], s, one)
            continue
        if last is not None:
            yield last
        last = (known, s, place)
    if last is not None:
        yield last


def _merge_level(table: pa.Table, ranges: int, unit: int) -> pa.Table:
    """The runs of some units in one range as one run, cut by finer ranges. Of equal strings only the earliest goes on, so
    a string that is everywhere is one entry of each run, and those get fewer from level to level."""
    removals = _Removals()
    strings, places = [], []
    for _, s, place in _distinct(table, removals):
        strings.append(s)
        places.append(place)
    return _rows(removals.rows() + _cut_run(strings, np.array(places, ORDER), ranges, unit))


def _merged(table: pa.Table) -> pa.Table:
    """Removals (rows with range -1) that the last merge of one range's runs finds."""
    removals = _Removals()
    group: list[list] = []  # [string, its earliest place]
    for known, s, place in _distinct(table, removals):
        if group and known < 8:
            _settle(group, removals.add)
            group.clear()
        group.append([s, place])
    if group:
        _settle(group, removals.add)
    return _rows(removals.rows())


def _settle(group: list[list], remove) -> None:
    """Compare the different strings of one hash window by window, earliest first."""
    windows = sum(len(s) - 8 - LENGTH + 1 for s, _ in group)
    if len(group) == 1:
        s = group[0][0]
        n = len(s) - 8 - LENGTH + 1
        if n == 1 or s.find(s[8 : 8 + GRAM], 9) < 0 and s.find(s[-GRAM:]) == len(s) - GRAM and len({s[8 + p : 8 + p + LENGTH] for p in range(n)}) == n:
            return
    group.sort(key=lambda g: (g[1]["id"], g[1]["th"], g[1]["start"]))
    passes = -(-windows // WINDOWS)
    for k in range(passes):
        seen: set[bytes] = set()
        for s, place in group:
            start, runs = int(place["start"]), []
            for p in range(len(s) - 8 - LENGTH + 1):
                window = s[8 + p : 8 + p + LENGTH]
                if passes > 1 and hash(window) % passes != k:
                    continue
                if window in seen:
                    if runs and runs[-1][1] == p:
                        runs[-1][1] = p + 1
                    else:
                        runs.append([p, p + 1])
                else:
                    seen.add(window)
            for a, b in runs:
                remove(place, start + a, start + b - 1 + LENGTH)


# -- result -----------------------------------------------------------------------------------------------------------


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) for spans that may overlap."""
    out, end, removed, n = [], 0, 0, 0
    for a, b in sorted(spans):
        if a > end or not n:
            out.append(text[end:a])
            n += 1
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
    out.append(text[end:])
    return b"".join(out), removed, n


def _final(docs: pa.Table, removals: pa.Table, with_text: bool) -> pa.Table:
    rows = sorted(zip(docs.column("id").to_pylist(), docs.column("th").to_pylist(), docs.column("text").to_pylist(), docs.column("doc_id").to_pylist(), strict=True), key=lambda r: r[:2])
    spans: dict[int, list[tuple[int, int]]] = {}
    for blob in removals.column("blob").to_pylist():
        for number, a, b in _unpack(blob, "i8")[0].reshape(-1, 3).tolist():
            spans.setdefault(number, []).append((a, b))
    out, first = [], 0
    for number, (i, th, text, doc_id) in enumerate(rows):
        if not number or rows[number - 1][:2] != (i, th):
            first = number
        left, removed, n = kept_bytes(text, spans.get(first, []))
        out.append((doc_id, len(text), removed, n, hashlib.sha256(left).hexdigest(), left if with_text else None))
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "n_bytes": pa.array(columns[1], pa.int64()), "n_removed": pa.array(columns[2], pa.int64()), "n_spans": pa.array(columns[3], pa.int64()), "kept_sha256": pa.array(columns[4], pa.string()), "kept": pa.array(columns[5], pa.binary())})


def _level(runs: DataFrame, finer: int) -> DataFrame:
    grouped = runs.filter("range >= 0").withColumn("unit", F.floor(F.col("unit") / FANIN)).groupBy("range", "unit")
    return grouped.applyInArrow(lambda key, t: _merge_level(t, finer, key[1].as_py()), RUNS)


def remove_repeats(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that are left) of every document."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), text.alias("text"))
    total = ready.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    ranges = max(8, -(-(total // 34) // RANGE_STRINGS))
    hot = max(hot, total // HOT_HASHES)
    steps = _steps(ranges)
    ready = ready.withColumn("th", F.xxhash64("text")).withColumn("bucket", F.pmod(F.xxhash64("id", "th"), F.lit(buckets)))
    found = ready.filter(F.octet_length("text") >= LENGTH).select("bucket", "text").mapInArrow(lambda b: _occurrences(b, ranges, steps[0]), DEALT)
    for wide, width in zip(steps, steps[1:], strict=False):
        found = found.repartition("range").sortWithinPartitions("range").mapInArrow(lambda b, wide=wide, width=width: _relayed(b, ranges, wide, width), DEALT)
    flags = Scratch.table(found.groupBy("range").applyInArrow(lambda t: _repeated(t, hot), "bucket bigint, flags binary"), "suffix-flags")
    # No more than HOT_HASHES hashes can occur so often: the list is bounded.
    many = [_unpack(bytes(r[0]), "u8")[0] for r in flags.filter("bucket < 0").select("flags").collect()]
    many = np.unique(np.concatenate(many)) if many else np.empty(0, U)
    repeated = flags.filter("bucket >= 0")
    bucketed = ready.select("bucket", "id", "th", "text").groupBy("bucket")
    # Fan-in is bounded: where there are more units than that, groups of them are merged first, in coarser ranges, so a
    # task always sees about as many strings and a run is never cut into crumbs.
    units, levels = buckets, 0
    while units > FANIN:
        units, levels = -(-units // FANIN), levels + 1
    now = max(1, -(-ranges // FANIN**levels))
    coarse = now
    runs = Scratch.table(bucketed.cogroup(repeated.groupBy("bucket")).applyInArrow(lambda d, f: _bucket_run(d, f, coarse, many), RUNS), "suffix-runs")
    Scratch.drop(flags)
    # Removals are few: written by themselves, they let a level's runs and exchanges go before the texts are exchanged again.
    own = lambda rows: Scratch.table(rows.select(F.col("unit").alias("bucket"), "blob"), "suffix-removals")
    removals = own(runs.filter("range < 0"))
    for _ in range(levels):
        now *= FANIN
        before, runs = runs, Scratch.table(_level(runs, now), "suffix-runs")
        Scratch.drop(before)
        removals = removals.unionByName(own(runs.filter("range < 0")))
    removals = removals.unionByName(own(runs.filter("range >= 0").groupBy("range").applyInArrow(_merged, RUNS)))
    Scratch.drop(runs)
    out = ready.groupBy("bucket").cogroup(removals.groupBy("bucket")).applyInArrow(lambda d, r: _final(d, r, with_text), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
