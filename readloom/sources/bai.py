"""The public bin index of alignment files (BAI, and CSI for references of more than 2^29 bases): built record by record,
merged from parts, written, read, and asked for the places of a reference.

A virtual offset is the place of a block in the file, times 2^16, plus the place in the block.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

MIN_SHIFT, DEPTH = 14, 5


def first_bin(level: int) -> int:
    """Number of the first bin of a level; level 0 is the one bin of everything."""
    return (8**level - 1) // 7


def bin_of(begin: int, end: int, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> int:
    """The smallest bin that holds [begin, end)."""
    last = max(begin, end - 1)
    for level in range(depth, 0, -1):
        shift = min_shift + 3 * (depth - level)
        if begin >> shift == last >> shift:
            return first_bin(level) + (begin >> shift)
    return 0


def bins_of(begin: int, end: int, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> list[int]:
    """All bins that may hold records of [begin, end)."""
    out = []
    for level in range(depth + 1):
        shift = min_shift + 3 * (depth - level)
        out += range(first_bin(level) + (begin >> shift), first_bin(level) + (max(begin, end - 1) >> shift) + 1)
    return out


@dataclass
class Reference:
    bins: dict[int, list[list[int]]] = field(default_factory=dict)
    windows: dict[int, int] = field(default_factory=dict)  # first offset of a record over each 2^14 bases
    low: int | None = None
    high: int = 0
    mapped: int = 0
    unmapped: int = 0


@dataclass
class Index:
    """Of each reference its bins of chunks; counts of records."""

    min_shift: int = MIN_SHIFT
    depth: int = DEPTH
    references: dict[int, Reference] = field(default_factory=dict)
    placeless: int = 0

    @staticmethod
    def deep_enough(length: int) -> Index:
        depth = DEPTH
        while length > 1 << (MIN_SHIFT + 3 * depth):
            depth += 1
        return Index(depth=depth)

    def add(self, ref: int, begin: int, end: int, mapped: bool, start: int, stop: int) -> None:
        """A record of [begin, end) whose bytes lie between two virtual offsets; records come in file order."""
        if ref < 0:
            self.placeless += 1
            return
        r = self.references.setdefault(ref, Reference())
        begin = max(0, begin)
        end = max(begin + 1, end)
        chunks = r.bins.setdefault(bin_of(begin, end, self.min_shift, self.depth), [])
        if chunks and chunks[-1][1] >> 16 >= start >> 16:
            chunks[-1][1] = stop
        else:
            chunks.append([start, stop])
        for w in range(begin >> self.min_shift, (end - 1 >> self.min_shift) + 1):
            r.windows[w] = min(start, r.windows.get(w, start))
        r.low = start if r.low is None else min(r.low, start)
        r.high = max(r.high, stop)
        r.mapped += mapped
        r.unmapped += not mapped

    def add_all(self, refs, begins, ends, mapped, starts, stops) -> None:
        """``add`` of many records, given as arrays. Records of one bin that follow one another are one chunk, block by
        block."""
        import numpy as np

        placed = refs >= 0
        self.placeless += int(len(refs) - placed.sum())
        refs, begins, ends, mapped, starts, stops = (x[placed] for x in (refs, begins, ends, mapped, starts, stops))
        if not len(refs):
            return
        begins = np.maximum(0, begins)
        last = np.maximum(begins + 1, ends) - 1
        bins = np.zeros(len(refs), np.int64)
        for level in range(1, self.depth + 1):  # the deepest level that holds a record decides
            shift = self.min_shift + 3 * (self.depth - level)
            same = begins >> shift == last >> shift
            bins[same] = first_bin(level) + (begins[same] >> shift)
        cuts = np.flatnonzero((refs[1:] != refs[:-1]) | (bins[1:] != bins[:-1]) | (stops[:-1] >> 16 < starts[1:] >> 16)) + 1
        heads, tails = np.append(0, cuts), np.append(cuts, len(refs)) - 1
        for ref, b, start, stop in zip(refs[heads].tolist(), bins[heads].tolist(), starts[heads].tolist(), stops[tails].tolist(), strict=True):
            chunks = self.references.setdefault(ref, Reference()).bins.setdefault(b, [])
            if chunks and chunks[-1][1] >> 16 >= start >> 16:
                chunks[-1][1] = stop
            else:
                chunks.append([start, stop])
        a, z = begins >> self.min_shift, last >> self.min_shift
        n = z - a + 1
        owner = np.repeat(np.arange(len(refs)), n)
        window = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + a[owner]
        # Records come in file order, so the first one over a window has its least offset.
        order = np.lexsort((window, refs[owner]))
        r, w = refs[owner][order], window[order]
        new = np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1]))
        for ref, win, start in zip(r[new].tolist(), w[new].tolist(), starts[owner][order][new].tolist(), strict=True):
            windows = self.references[ref].windows
            windows[win] = min(start, windows.get(win, start))
        names, which = np.unique(refs, return_inverse=True)
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.zeros(len(names), np.int64)
        np.minimum.at(low, which, starts)
        np.maximum.at(high, which, stops)
        count = np.bincount(which, minlength=len(names))
        hits = np.bincount(which[mapped], minlength=len(names))
        for ref, lo, hi, k, all_ in zip(names.tolist(), low.tolist(), high.tolist(), hits.tolist(), count.tolist(), strict=True):
            x = self.references[ref]
            x.low, x.high = lo if x.low is None else min(x.low, lo), max(x.high, hi)
            x.mapped, x.unmapped = x.mapped + k, x.unmapped + all_ - k

    def absorb(self, other: Index, shift: int = 0) -> None:
        """Add the index of a later part of the file, whose offsets are ``shift`` bytes short."""
        by = shift << 16
        for ref, o in other.references.items():
            r = self.references.setdefault(ref, Reference())
            for b, chunks in o.bins.items():
                into = r.bins.setdefault(b, [])
                for start, stop in chunks:
                    if into and into[-1][1] >> 16 >= (start + by) >> 16:
                        into[-1][1] = stop + by
                    else:
                        into.append([start + by, stop + by])
            for w, v in o.windows.items():
                r.windows[w] = min(v + by, r.windows.get(w, v + by))
            if o.low is not None:
                r.low = o.low + by if r.low is None else min(r.low, o.low + by)
                r.high = max(r.high, o.high + by)
            r.mapped += o.mapped
            r.unmapped += o.unmapped
        self.placeless += other.placeless

    def places(self, ref: int, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
        """Virtual offsets [start, stop) of all records over [begin, end) of a reference, merged and in order."""
        r = self.references.get(ref)
        if r is None:
            return []
        if end is None:
            chunks = [c for chunks in r.bins.values() for c in chunks]
            least = 0
        else:
            chunks = [c for b in bins_of(begin, end, self.min_shift, self.depth) for c in r.bins.get(b, ())]
            # No record over the window begins before its first offset; an empty window has that of the next one below.
            before = [w for w in r.windows if w <= begin >> self.min_shift]
            least = r.windows[max(before)] if before else 0
        out: list[list[int]] = []
        for start, stop in sorted(c for c in chunks if c[1] > least):
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], stop)
            else:
                out.append([start, stop])
        return [tuple(c) for c in out]

    # -- bytes ---------------------------------------------------------------------------------------------------------

    @property
    def suffix(self) -> str:
        return ".bai" if (self.min_shift, self.depth) == (MIN_SHIFT, DEPTH) else ".csi"

    def _counts_bin(self) -> int:
        return first_bin(self.depth + 1) + 1

    def dump(self, n_refs: int) -> bytes:
        """The index file's bytes: BAI of the usual depth, else CSI."""
        csi = self.suffix == ".csi"
        out = [b"CSI\1" + struct.pack("<iii", self.min_shift, self.depth, 0) if csi else b"BAI\1", struct.pack("<i", n_refs)]
        for ref in range(n_refs):
            r = self.references.get(ref)
            bins = sorted(r.bins.items()) if r else []
            if r:
                bins.append((self._counts_bin(), [[r.low, r.high], [r.mapped, r.unmapped]]))
            out.append(struct.pack("<i", len(bins)))
            for b, chunks in bins:
                out.append(struct.pack("<I", b))
                if csi:
                    out.append(struct.pack("<Q", min((c[0] for c in chunks), default=0) if b != self._counts_bin() else 0))
                out.append(struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            if not csi:
                windows = [0] * (max(r.windows) + 1) if r and r.windows else []
                last = 0
                for w in range(len(windows)):
                    windows[w] = last = r.windows.get(w, last)
                out.append(struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows))
        out.append(struct.pack("<Q", self.placeless))
        data = b"".join(out)
        if not csi:
            return data
        from .bam import END_BLOCK, pack_blocks

        return pack_blocks(data) + END_BLOCK

    @staticmethod
    def load(data: bytes) -> Index:
        if data[:2] == b"\x1f\x8b":
            parts, rest = [], data
            while rest:
                unpacker = zlib.decompressobj(31)
                parts.append(unpacker.decompress(rest))
                rest = unpacker.unused_data
            data = b"".join(parts)
        csi = data[:4] == b"CSI\1"
        if not csi and data[:4] != b"BAI\1":
            raise ValueError("not an index of alignments")
        out, at = Index(), 4
        if csi:
            out.min_shift, out.depth, aux = struct.unpack_from("<iii", data, at)
            at += 12 + aux
        (n_refs,) = struct.unpack_from("<i", data, at)
        at += 4
        for ref in range(n_refs):
            (n_bins,) = struct.unpack_from("<i", data, at)
            at += 4
            if not n_bins and (csi or not struct.unpack_from("<i", data, at)[0]):
                at += 0 if csi else 4  # most references of a file among many have nothing
                continue
            r = Reference()
            for _ in range(n_bins):
                (b,) = struct.unpack_from("<I", data, at)
                at += 12 if csi else 4
                (n,) = struct.unpack_from("<i", data, at)
                chunks = [list(struct.unpack_from("<QQ", data, at + 4 + 16 * i)) for i in range(n)]
                at += 4 + 16 * n
                if b == out._counts_bin():
                    (r.low, r.high), (r.mapped, r.unmapped) = chunks
                else:
                    r.bins[b] = chunks
            if not csi:
                (n,) = struct.unpack_from("<i", data, at)
                r.windows = {w: v for w, v in enumerate(struct.unpack_from(f"<{n}Q", data, at + 4)) if v}
                at += 4 + 8 * n
            if n_bins:
                out.references[ref] = r
        if at + 8 <= len(data):
            (out.placeless,) = struct.unpack_from("<Q", data, at)
        return out
