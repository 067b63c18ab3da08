"""Periodic runs of words, found on the grammar of a text.

The word ids of a batch of texts are compressed by Re-Pair: again and again the pairs that occur more often than the
ones they overlap become new symbols, until no pair occurs twice. What is left of each text is joined by a balanced
binary tree, so that every symbol but a word has two parts and a boundary between them. A run of words lies across the
boundary of the smallest symbol that holds it; hence the runs across each symbol's boundary are computed once, where the
symbol first stands, translated to all places it was put at, and merged where they are parts of one stretch.

Across a boundary b a run of period q of twice that length reaches at least q words to one side, so word b - 1 equals
word b - 1 + q, or word b - q equals word b. As a run has 12 words at least, four words about that place recur too: only
boundaries at repeated four words are looked at, and texts without any leave at the start. How far such a match goes is
read from ids of stretches of 1, 2, 4, 8 ... words.

Defined cases: null texts have no words; words are runs without ASCII white space; long texts are read whole; equal rows
have equal results; a null doc_id is not rewritten by ``planted``; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

LEAST = 12
#: Pairs of boundary and period that are looked at together.
CHUNK = 1 << 21


def number(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0."""
    return pd.factorize(keys)[0]


@dataclass
class Symbols:
    """Symbols of two parts: text places [low, high) with the boundary between the parts, where each first stands; and
    every place (owner: number of the symbol, place: where it begins)."""

    low: np.ndarray
    boundary: np.ndarray
    high: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def re_pair(ids: np.ndarray, ends: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Symbols of the texts that end at ``ends`` in ids, and where the symbols that remain begin."""
    symbol, start = ids.astype(np.int64), np.arange(len(ids))
    last = np.zeros(len(ids) + 1, bool)  # places at which a text ends
    last[ends] = True
    fresh, made = int(ids.max(initial=-1)) + 1, []
    while len(symbol) > 1:
        stop = np.append(start[1:], len(ids))
        pair = ~last[stop[:-1]]  # with the next symbol of the same text
        index = np.arange(len(symbol))
        opens = np.append(True, (symbol[1:] != symbol[:-1]) | ~pair)
        odd = (index - np.maximum.accumulate(np.where(opens, index, 0))) % 2 == 1
        pair &= ~((symbol[:-1] == symbol[1:]) & odd[:-1])
        at = np.flatnonzero(pair)
        code = number(symbol[at] * (fresh + 1) + symbol[at + 1])
        often = np.bincount(code)
        if not len(code) or often.max() < 2:
            break
        # A pair goes where it is more frequent than both pairs that it overlaps. Equal ones are ordered by scattered
        # numbers: in order of appearance, a repeated passage would lose one pair a round.
        rank = np.full(len(symbol) + 1, -1)
        twice = often[code] >= 2
        rank[at[twice] + 1] = often[code[twice]] << 32 | code[twice] * 2654435761 & 0xFFFFFFFF
        here = rank[at + 1]
        chosen = twice & (here > rank[at]) & (here > np.append(rank, -1)[at + 2])
        kept = np.bincount(code[chosen], minlength=len(often)) >= 2
        chosen &= kept[code]
        at, code = at[chosen], number(code[chosen])
        first = np.unique(code, return_index=True)[1]
        made.append((start[at[first]], start[at[first] + 1], stop[at[first] + 1], code + sum(len(m[0]) for m in made), start[at]))
        symbol[at] = fresh + code
        fresh += len(first)
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        symbol, start = symbol[stay], start[stay]
    none = np.empty(0, np.int64)
    return Symbols(*[np.concatenate([none, *(m[i] for m in made)]).astype(np.int64) for i in range(5)]), start


def balanced(start: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """low, boundary, high of the inner nodes of a balanced tree over each text's symbols, which begin at start."""
    text = np.searchsorted(ends, start, side="right")
    low, high = start, np.append(start[1:], ends[-1] if len(ends) else 0)
    out = []
    while True:
        index = np.arange(len(low))
        opens = np.append(True, text[1:] != text[:-1])
        rank = index - np.maximum.accumulate(np.where(opens, index, 0))
        left = np.flatnonzero((rank % 2 == 0) & np.append(~opens[1:], False))
        if not len(left):
            break
        out.append((low[left], low[left + 1], high[left + 1]))
        high = high.copy()
        high[left] = high[left + 1]
        stay = np.ones(len(low), bool)
        stay[left + 1] = False
        low, high, text = low[stay], high[stay], text[stay]
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *(o[i] for o in out)]) for i in range(3))


class Stretches:
    """Ids of stretches of 2^k words; equal ids, equal words."""

    def __init__(self, ids: np.ndarray):
        self.levels = [ids.astype(np.int32)]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            x, n = self.levels[-1].astype(np.int64), 1 << (len(self.levels) - 1)
            pairs = x[: max(0, len(x) - n)] << 32 | x[n:]
            self.levels.append(number(pairs).astype(np.int32))
        return self.levels[k]

    def same(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether 2^k words from i and from j are equal (false where there are not so many)."""
        ids = self.level(k)
        inside = (i >= 0) & (j >= 0) & (np.maximum(i, j) < len(ids))
        out = np.zeros(len(i), bool)
        out[inside] = ids[i[inside]] == ids[j[inside]]
        return out

    def reach(self, i: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch [s, e) about i in which every word equals the one q places on, within [low, high)."""
        s, e = i.copy(), i.copy()
        top = max(0, int((high - low).max(initial=1)).bit_length() - 1)
        for k in range(top, -1, -1):
            n = 1 << k
            e = np.where((e + q + n <= high) & self.same(k, e, e + q), e + n, e)
            s = np.where((s - n >= low) & self.same(k, s - n, s - n + q), s - n, s)
        return s, e


def across(stretches: Stretches, low: np.ndarray, boundary: np.ndarray, high: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
    """node, s, e, q of the runs across each node's boundary: words [s, e + q) with period q, as long as a run has to be."""
    flag = np.concatenate([np.zeros(4, bool), repeated, np.zeros(8, bool)])  # flag[4 + i]: four words from i recur
    right, left = flag[boundary + 3] | flag[boundary], flag[boundary + 4] | flag[boundary + 1]
    live = np.flatnonzero((right | left) & (high - low >= LEAST))
    spans = (high - low)[live] // 2
    found = [[], [], [], []]
    upto = np.cumsum(spans)
    done = 0
    while done < len(live):
        # A node may be larger than a chunk; it is taken alone then.
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + CHUNK, side="right")))
        node = np.repeat(live[done:stop], spans[done:stop])
        q = np.arange(len(node)) - np.repeat(np.cumsum(spans[done:stop]) - spans[done:stop], spans[done:stop]) + 1
        done = stop
        b = boundary[node]
        for seed in (b - 1, b - q):
            hit = stretches.same(2, seed, seed + q) | stretches.same(2, seed - 3, seed - 3 + q)
            hit &= (seed >= low[node]) & (seed + q < high[node])
            k, i, p = node[hit], seed[hit], q[hit]
            if not len(k):
                continue
            s, e = stretches.reach(i, p, low[k], high[k])
            good = e - s + p >= np.maximum(LEAST, 2 * p)
            for into, x in zip(found, (k, s, e, p), strict=True):
                into.append(x[good])
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in found)


def runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text (word ids), by start and period."""
    out = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    every = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    # Four words that recur within their text.
    four = Stretches(every).level(2)
    inside = np.flatnonzero(owner[: len(four)] == owner[3 : 3 + len(four)])
    code = number(owner[inside] << 40 | four[inside].astype(np.int64))
    again = np.zeros(len(every), bool)
    again[inside] = np.bincount(code)[code] > 1 if len(code) else False
    active = np.bincount(owner, again, len(texts)) > 0
    which = np.flatnonzero(active)
    if not len(which):
        return out
    keep = active[owner]
    ids, repeated, sizes = number(every[keep]), again[keep], sizes[which]
    ends = np.cumsum(sizes)
    symbols, rest = re_pair(ids, ends)
    stretches = Stretches(ids)
    node, s, e, q = across(stretches, symbols.low, symbols.boundary, symbols.high, repeated)
    # To every place of the symbol.
    order = np.argsort(symbols.owner, kind="stable")
    times = np.bincount(symbols.owner, minlength=len(symbols.low))
    begins = np.cumsum(times) - times
    many = times[node]
    each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    shift = symbols.place[order[np.repeat(begins[node], many) + each]] - np.repeat(symbols.low[node], many)
    top = across(stretches, *balanced(rest, ends), repeated)
    s, e, q = (np.concatenate(x) for x in ((np.repeat(s, many) + shift, top[1]), (np.repeat(e, many) + shift, top[2]), (np.repeat(q, many), top[3])))
    if not len(s):
        return out
    # Stretches of one text and period that overlap are parts of one.
    text = np.searchsorted(ends, s, side="right")
    order = np.lexsort((e, s, q, text))
    s, e, q, text = s[order], e[order], q[order], text[order]
    group = np.append(True, (text[1:] != text[:-1]) | (q[1:] != q[:-1]))
    far = pd.Series(e).groupby(np.cumsum(group)).cummax().to_numpy()
    heads = np.flatnonzero(group | np.append(True, s[1:] > far[:-1]))
    start, end, q, text = s[heads], np.maximum.reduceat(e, heads) + q[heads], q[heads], text[heads]
    # A stretch has the multiples of its least period too.
    order = np.lexsort((q, end, start, text))
    start, end, q, text = start[order], end[order], q[order], text[order]
    least = np.append(True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
    base = np.append(0, ends)
    for t, a, z, p in zip(text[least].tolist(), start[least].tolist(), end[least].tolist(), q[least].tolist(), strict=True):
        out[which[t]].append((a - int(base[t]), z - a, p))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def planted(n: int, doc_id: int | None) -> np.ndarray:
    """Which original word stands at each place: in a tenth of the documents the end is made periodic."""
    index = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        index[a:] = a + (index[a:] - a) % p
    return index


def report(words: np.ndarray, found: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    kept = words[np.cumsum(dropped[:-1]) == 0] if found else words
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in found)
    return len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept.tolist())).hexdigest()


def run_reports(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_runs and the longest run of every document, with hashes of all runs and of the text without repeats."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            words = []
            for doc_id, text in zip(doc_ids, batch.column(1).to_pylist(), strict=True):
                own = np.array((text or "").encode().split(), dtype=object)
                words.append(own[planted(len(own), doc_id)] if plant else own)
            ids = number(np.concatenate(words)) if words else np.empty(0, np.int64)
            found = runs(np.split(ids, np.cumsum([len(w) for w in words])[:-1]) if words else [])
            rows = [(d, *report(w, f)) for d, w, f in zip(doc_ids, words, found, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ready.mapInArrow(run, "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
