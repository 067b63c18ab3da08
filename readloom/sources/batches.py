"""Records of alignment files as columns: encoded, decoded and placed a batch at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASES = np.frombuffer(b"=ACMGRSVTWYHKDBN", np.uint8)
PAIRS = np.stack([np.repeat(BASES, 16), np.tile(BASES, 16)], axis=1)  # the two bases of a byte
OPERATIONS = "MIDNSHP=X"
_codes = lambda letters: np.array([o in letters for o in OPERATIONS] + [False] * 7)
ON_REFERENCE, ON_QUERY, HARD, SOFT = (_codes(x) for x in ("MDN=X", "MIS=X", "H", "S"))
HEAD = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("length", "<i4")])
INTEGERS = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4"}
WIDTH = np.zeros(256, np.int64)
for _kind, _n in {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}.items():
    WIDTH[ord(_kind)] = _n


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all bytes of stretches of data."""
    offsets = offsets_of(lengths)
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)


def field(data: np.ndarray, at: np.ndarray, kind: str | np.dtype) -> np.ndarray:
    """Values of a type at any places of data."""
    kind = np.dtype(kind)
    return data[at[:, None] + np.arange(kind.itemsize)].view(kind).ravel()


def put(data: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    width = values.dtype.itemsize
    data[at[:, None] + np.arange(width)] = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of strings or bytes, and where each value begins and the last one ends."""
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def ragged(kind: pa.DataType, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A column of the stretches of data."""
    offsets = offsets_of(lengths).astype(np.int32)
    out = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[spread(starts, lengths)])])
    return out if null is None or not null.any() else pc.if_else(pa.array(null), pa.scalar(None, kind), out)


def encode(names: pa.Array, ref: np.ndarray, pos: np.ndarray, matches: np.ndarray, reverse: np.ndarray, mapq: np.ndarray, tags: dict[str, pa.Array]) -> pa.Array:
    """Records of one stretch of matches each, without their sizes and without a sequence."""
    out, at = _encode(names, ref, pos, matches, reverse, mapq, tags, 0)
    return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])


def encode_with_sizes(*record) -> tuple[np.ndarray, np.ndarray]:
    """The records of ``encode`` one after another, each behind its size; and where each ends."""
    out, at = _encode(*record, 4)
    put(out, at[:-1], (np.diff(at) - 4).astype("<i4"))
    return out, at[1:]


def _encode(names: pa.Array, ref: np.ndarray, pos: np.ndarray, matches: np.ndarray, reverse: np.ndarray, mapq: np.ndarray, tags: dict[str, pa.Array], room: int) -> tuple[np.ndarray, np.ndarray]:
    """The records' bytes, each behind so many bytes of room, and where these begin and the last record ends."""
    data, offsets = flat(names)
    n, length = len(names), np.diff(offsets)
    if n and (length.max() > 254 or mapq.min() < 0 or mapq.max() > 255):
        raise ValueError("a read name of more than 254 bytes, or a mapping quality beyond 255")
    present = {t: ~np.asarray(c.is_null()) for t, c in tags.items()}
    sizes = room + 32 + length + 1 + 4 + 7 * sum(m.astype(np.int64) for m in present.values())
    at = offsets_of(sizes)
    out, starts = np.zeros(at[-1], np.uint8), at[:-1] + room
    head = np.zeros(n, HEAD)
    for k, v in {"ref": ref, "pos": pos, "n_name": length + 1, "mapq": mapq, "n_cigar": 1, "flag": np.where(reverse, 16, 0), "mate": -1, "mate_pos": -1}.items():
        head[k] = v
    put(out, starts, head)
    out[spread(starts + 32, length)] = data[offsets[0] : offsets[-1]]
    put(out, starts + 33 + length, (matches << 4).astype("<u4"))
    place = starts + 37 + length
    for t, column in tags.items():
        has = present[t]
        tag = np.zeros(int(has.sum()), np.dtype([("name", "S2"), ("kind", "S1"), ("value", "<i4")]))
        tag["name"], tag["kind"], tag["value"] = t.encode(), b"i", np.asarray(column.drop_null())
        put(out, place[has], tag)
        place[has] += 7
    return out, at


def with_sizes(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The records of a column one after another, each behind its size; and where each ends."""
    data, offsets = flat(raw)
    lengths = np.diff(offsets)
    ends = np.cumsum(lengths + 4)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    starts = ends - lengths
    out[spread(starts, lengths)] = data[offsets[0] : offsets[-1]]
    put(out, starts - 4, lengths.astype("<i4"))
    return out, ends


def operations(data: np.ndarray, starts: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record, length and code of each operation of all records' CIGARs."""
    counts = head["n_cigar"].astype(np.int64)
    ops = data[spread(starts + 32 + head["n_name"], 4 * counts)].view("<u4")
    return np.repeat(np.arange(len(starts)), counts), (ops >> 4).astype(np.int64), (ops & 15).astype(np.int64)


def total(n: int, owner: np.ndarray, length: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return np.bincount(owner[chosen], weights=length[chosen], minlength=n).astype(np.int64)


def extents(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reference number, begin, end and whether it is mapped, of the records at these places."""
    head = field(data, starts, HEAD)
    owner, length, code = operations(data, starts, head)
    begin = head["pos"].astype(np.int64)
    span = total(len(starts), owner, length, ON_REFERENCE[code])
    return head["ref"].astype(np.int64), begin, begin + np.maximum(1, span), head["flag"] & 4 == 0


def integer_tags(data: np.ndarray, at: np.ndarray, end: np.ndarray, names: Sequence[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Values and presence of integer tags. The first tags of all records are read, then the second ones, and so on."""
    out = {t: (np.zeros(len(at), np.int64), np.zeros(len(at), bool)) for t in names}
    at, zeros = at.copy(), None
    live = np.flatnonzero(at + 3 <= end)
    while len(live):
        name, kind, body = field(data, at[live], "<u2"), data[at[live] + 2], at[live] + 3
        width = WIDTH[kind]
        text, many = (kind == ord("Z")) | (kind == ord("H")), kind == ord("B")
        if text.any():
            zeros = np.flatnonzero(data == 0) if zeros is None else zeros
            width[text] = zeros[np.searchsorted(zeros, body[text])] - body[text] + 1
        if many.any():
            width[many] = 5 + WIDTH[data[body[many]]] * field(data, body[many] + 1, "<i4")
        if (width <= 0).any():
            raise ValueError("a tag of unknown type")
        for t, (values, present) in out.items():
            mine = name == int.from_bytes(t.encode(), "little")
            if mine.any():
                for k, form in INTEGERS.items():
                    of_kind = mine & (kind == ord(k))
                    values[live[of_kind]] = field(data, body[of_kind], form)
                    present[live[of_kind]] = True
        at[live] = body + width
        live = live[at[live] + 3 <= end[live]]
    return out


def columns(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, names: pa.Array, raw: bool, schema: pa.Schema) -> pa.RecordBatch:
    """The records at these places as rows of the alignment schema."""
    n, head = len(starts), field(data, starts, HEAD)
    owner, length, code = operations(data, starts, head)
    known = head["n_cigar"] > 0
    span, inferred, hard, soft = (total(n, owner, length, kind[code]) for kind in (ON_REFERENCE, ON_QUERY, HARD, SOFT))
    n_name, n_cigar, n_seq = (head[c].astype(np.int64) for c in ("n_name", "n_cigar", "n_seq"))
    pos, ref = head["pos"].astype(np.int64), head["ref"].astype(np.int64)
    packed, bases = starts + 32 + n_name + 4 * n_cigar, (n_seq + 1) // 2
    tags = integer_tags(data, packed + bases + n_seq, starts + sizes, ("NM", "AS", "XO", "XG"))
    unpacked = PAIRS[data[spread(packed, bases)]].ravel()
    steps = pc.binary_join_element_wise(pa.array(length).cast(pa.string()), pa.array(list(OPERATIONS)).take(pa.array(code)), "")
    cigar = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets_of(n_cigar).astype(np.int32)), steps), "")
    number = lambda values, ok=None: pa.array(values, mask=None if ok is None else ~ok)
    found = {
        "query_name": ragged(pa.string(), data, starts + 32, n_name - 1),
        "reference": names.take(number(ref, (ref >= 0) & (ref < len(names)))),
        "reference_start": number(pos, pos >= 0), "reference_end": number(pos + span, (pos >= 0) & known),
        "is_reverse": pa.array(head["flag"] & 16 != 0), "mapping_quality": number(head["mapq"]),
        "query_sequence": ragged(pa.string(), unpacked, offsets_of(2 * bases)[:-1], n_seq, n_seq == 0),
        "query_length": number(n_seq), "inferred_query_length": number(inferred, known), "inferred_read_length": number(inferred + hard, known),
        "query_alignment_length": number(np.where(known, inferred - soft, n_seq)),
        "nm": number(*tags["NM"]), "as_score": number(*tags["AS"]), "xo": number(*tags["XO"]), "xg": number(*tags["XG"]),
        "flag": number(head["flag"]), "cigar": pc.if_else(pa.array(known), cigar, pa.scalar(None, pa.string())),
        "raw": ragged(pa.binary(), data, starts, sizes) if raw else pa.nulls(n, pa.binary()),
    }
    return pa.RecordBatch.from_arrays([found[f.name].cast(f.type) for f in schema], schema=schema)
