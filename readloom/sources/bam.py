"""Alignment files (BAM) as a Spark data source, after the public SAM/BAM specification. Needs no native library.

``register(spark)`` makes ``spark.read.format("bam").load(path)`` and ``df.write.format("bam").save(path)`` work on any
store that ``store`` knows; tasks read ranges, never whole files. A path may be one file or a folder of them, which is
how large results are written (``layout`` ``files``). ``read_binary`` takes whole files from Spark's own reader.

A file is cut by bytes. Each task finds the first compressed block after its cut, and the first record by checking
where a chain of plausible records begins, so no one reads the file in sequence. Where a file has an index (BAI or CSI),
a filter on ``reference`` becomes the ranges of its blocks, and nothing else is opened. Files written in order of place
get an index from the parts' own ones; ``build_index`` makes one for any file in that order.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..schema import ALIGNMENT, REFERENCES
from ..session import ship
from . import store
from .bai import Index

BLOCK_HEAD = 18
SPLIT_BYTES = 32 << 20
# Fixed value of the specification: an empty block ends every file.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
#: Operations that advance along the reference, and along the stored sequence.
ON_REFERENCE, ON_QUERY = frozenset("MDN=X"), frozenset("MIS=X")
TAG_SIZE = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
TAG_CODE = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I"}
TAGS = {b"NM": "nm", b"AS": "as_score", b"XO": "xo", b"XG": "xg"}
#: Columns that no statistic of references is made of.
UNMEASURED = ("raw", "cigar", "flag", "is_reverse", "query_length", "xo", "xg")


class BamError(ValueError):
    """The file isn't what the specification describes."""


# -- blocks -----------------------------------------------------------------------------------------------------------


def block_size(head: bytes) -> int:
    """Size of the block that begins with these 18 bytes (one BC field in front, as all writers put it)."""
    if len(head) < BLOCK_HEAD or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
        raise BamError("not a BGZF block")
    return struct.unpack_from("<H", head, 16)[0] + 1


def unpack_block(block: bytes) -> bytes:
    try:
        return zlib.decompress(block, 31)
    except zlib.error as e:
        raise BamError(f"a block doesn't unpack: {e}") from e


def pack_blocks(data: bytes, size: int = 60_000, level: int = 6) -> bytes:
    """data as compressed blocks, without the end block."""
    out = []
    for at in range(0, len(data), size):
        part = data[at : at + size]
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def read_blocks(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the blocks from an offset on."""
    file.seek(start)
    while len(head := file.read(BLOCK_HEAD)) == BLOCK_HEAD:
        size = block_size(head)
        block = head + file.read(size - BLOCK_HEAD)
        if len(block) < size:
            raise BamError(f"the block at {start} is cut short")
        yield start, unpack_block(block)
        start += size


def next_block(file, start: int, end: int, chain: int = 3) -> int | None:
    """Offset of the first block that begins in [start, end): one that leads to further blocks or the file's end."""
    file.seek(start)
    window = file.read(max(0, min(end - start, 1 << 16)) + BLOCK_HEAD)
    at = window.find(b"\x1f\x8b\x08\x04")
    while at != -1 and start + at < end:
        place, n = start + at, 0
        while n < chain:
            file.seek(place)
            head = file.read(BLOCK_HEAD)
            if not head:
                n = chain
            elif len(head) < BLOCK_HEAD or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
                break
            else:
                place, n = place + block_size(head), n + 1
        if n == chain:
            return start + at
        at = window.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


# -- header -----------------------------------------------------------------------------------------------------------


def parse_header(data: bytes) -> tuple[str, list[tuple[str, int]], int] | None:
    """(text, references, bytes used), or None if data ends within the header."""
    try:
        if data[:4] != b"BAM\1":
            if len(data) >= 4:
                raise BamError("not a BAM file")
            return None
        (n,) = struct.unpack_from("<i", data, 4)
        text = data[8 : 8 + n].rstrip(b"\0").decode()
        at = 8 + n
        (count,) = struct.unpack_from("<i", data, at)
        at += 4
        out = []
        for _ in range(count):
            (n,) = struct.unpack_from("<i", data, at)
            name = data[at + 4 : at + 3 + n].decode()
            (length,) = struct.unpack_from("<i", data, at + 4 + n)
            out.append((name, length))
            at += 8 + n
    except struct.error:
        return None
    return text, out, at


def read_header(path: str) -> tuple[str, list[tuple[str, int]], tuple[int, int]]:
    """(text, references, place of the first record as block offset and offset in the block)."""
    with store.open_in(path) as f:
        data, starts, enough = bytearray(), [], 0
        for offset, block in read_blocks(f, 0):
            starts.append((offset, len(data)))
            data += block
            if len(data) < enough:
                continue
            enough = 2 * len(data)  # a long header is not parsed again with each block of it
            if (found := parse_header(bytes(data))) is not None:
                used = found[2]
                offset, before = max(s for s in starts if s[1] <= used)
                return found[0], found[1], (offset, used - before)
        if (found := parse_header(bytes(data))) is not None:
            offset, before = max(s for s in starts if s[1] <= found[2])
            return found[0], found[1], (offset, found[2] - before)
    raise BamError("the header is cut short")


class Headers:
    """``read_header`` of many files. Files written together begin with the same bytes: those are compared, not parsed."""

    def __init__(self):
        self.same, self.last = b"", None

    def of(self, path: str) -> tuple[str, list[tuple[str, int]], tuple[int, int]]:
        if self.same:
            with store.open_in(path) as f:
                if f.read(len(self.same)) == self.same:
                    return self.last
        self.last = read_header(path)
        with store.open_in(path) as f:  # only a header that ends with its block can be told by its bytes
            self.same = f.read(self.last[2][0]) if self.last[2][1] == 0 else b""
        return self.last


def header_bytes(text: str, references: Sequence[tuple[str, int]]) -> bytes:
    raw = text.encode()
    out = [b"BAM\1", struct.pack("<i", len(raw)), raw, struct.pack("<i", len(references))]
    for name, length in references:
        out.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length))
    return b"".join(out)


def reduced_header(text: str, keep: Sequence[str], order: str) -> str:
    """The header's lines with only the kept references and the given sort order."""
    kept, out = set(keep), []
    for line in text.splitlines():
        fields = line.split("\t")
        if fields[0] == "@SQ" and not any(f[:3] == "SN:" and f[3:] in kept for f in fields):
            continue
        if fields[0] == "@HD":
            line = "\t".join([f for f in fields if not f.startswith("SO:")] + [f"SO:{order}"])
        out.append(line)
    if not any(line.startswith("@HD") for line in out):
        out.insert(0, f"@HD\tVN:1.0\tSO:{order}")
    return "\n".join(out) + "\n"


# -- records ----------------------------------------------------------------------------------------------------------


def tags_of(data: bytes) -> dict[bytes, int]:
    """The integer tags that are columns."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2], data[at + 2 : at + 3]
        at += 3
        if kind in (b"Z", b"H"):
            at = data.index(b"\0", at) + 1
        elif kind == b"B":
            at += 5 + TAG_SIZE[data[at : at + 1]] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            if name in TAGS and kind in TAG_CODE:
                out[name] = struct.unpack_from(TAG_CODE[kind], data, at)[0]
            at += TAG_SIZE[kind]
    return out


def parse_record(raw: bytes, names: Sequence[str]) -> tuple:
    """A row of the alignment schema; raw is the record without its size."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, _, _, _ = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    name = raw[at : at + n_name - 1].decode()
    at += n_name
    cigar = [(c >> 4, OPERATIONS[c & 15]) for c in struct.unpack_from(f"<{n_cigar}I", raw, at)]
    at += 4 * n_cigar
    packed = raw[at : at + (n_seq + 1) // 2]
    at += (n_seq + 1) // 2 + n_seq
    sequence = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq] if n_seq else None
    tags = tags_of(raw[at:])
    span = sum(n for n, op in cigar if op in ON_REFERENCE)
    inferred = sum(n for n, op in cigar if op in ON_QUERY)
    hard = sum(n for n, op in cigar if op == "H")
    soft = sum(n for n, op in cigar if op == "S")
    known = bool(cigar)
    aligned = inferred - soft if known else n_seq
    value = lambda t: tags.get(t)
    return (
        name, names[ref] if 0 <= ref < len(names) else None, pos if pos >= 0 else None, pos + span if pos >= 0 and known else None,
        bool(flag & 16), mapq, sequence, n_seq, inferred if known else None, inferred + hard if known else None, aligned,
        value(b"NM"), value(b"AS"), value(b"XO"), value(b"XG"), flag, "".join(f"{n}{op}" for n, op in cigar) or None, raw,
    )


def plausible(data: bytes, at: int, n_refs: int) -> int | None:
    """Where the record at this place would end, if it looks like one."""
    if at + 36 > len(data):
        return None
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not 33 <= size < 1 << 28 or not -1 <= ref < n_refs or not -1 <= mate < n_refs or pos < -1 or mate_pos < -1 or n_name < 2 or n_seq < 0:
        return None
    if 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq > size:
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def first_record(data: bytes, n_refs: int, chain: int = 8) -> int | None:
    """The first place from which on a chain of records leads (to the end of data or ``chain`` records on)."""
    for at in range(len(data) - 36):
        to, n = at, 0
        while n < chain and (nxt := plausible(data, to, n_refs)) is not None:
            to, n = nxt, n + 1
            if to >= len(data):
                break
        if n == chain or (n and to >= len(data) - 36):
            return at
    return None


def records_of(file, start: int, inside: int | None, end: int, n_refs: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, bytes) of the records that begin in blocks from ``start`` to before ``end``; inside: place of the
    first one, None to look."""
    blocks = read_blocks(file, start)
    buffer, limit = b"", None  # limit: where in buffer the own blocks end, once known
    marks: list[tuple[int, int]] = []  # where in buffer the own blocks begin

    def more() -> bool:
        nonlocal buffer, limit
        for offset, block in blocks:
            if offset >= end and limit is None:
                limit = len(buffer)
            marks.append((len(buffer), offset))
            buffer += block
            return True
        return False

    for _ in range(8 if inside is None else 1):
        if not more():
            break
    at = first_record(buffer, n_refs) if inside is None else inside
    if at is None:
        return
    mark = 0
    while limit is None or at < limit:
        while len(buffer) < at + 4:
            if not more():
                if len(buffer) > at:
                    raise BamError("the last record is cut short")
                return
        if limit is not None and at >= limit:
            return
        (size,) = struct.unpack_from("<i", buffer, at)
        while len(buffer) < at + 4 + size:
            if not more():
                raise BamError("the last record is cut short")
        while mark + 1 < len(marks) and marks[mark + 1][0] <= at:
            mark += 1
        yield marks[mark][1] << 16 | at - marks[mark][0], buffer[at + 4 : at + 4 + size]
        at += 4 + size
        if at > 1 << 20:
            buffer, limit = buffer[at:], None if limit is None else limit - at
            marks[:] = [(a - at, o) for a, o in marks[mark:]]
            at = mark = 0


def chunks_of(file, start: int, inside: int | None, end: int, n_refs: int, blocks_at_once: int = 64):
    """The records of ``records_of``, many at a time: (bytes, where in them each begins, their sizes, their virtual offsets)."""
    import numpy as np

    blocks = read_blocks(file, start)
    buffer, limit, at = b"", None, inside
    marks: list[tuple[int, int]] = []
    while True:
        parts, size, more = [buffer], len(buffer), False
        for offset, block in blocks:
            more = True
            if offset >= end and limit is None:
                limit = size
            marks.append((size, offset))
            parts.append(block)
            size += len(block)
            if limit is not None or len(parts) > blocks_at_once:
                break
        buffer = b"".join(parts)
        if at is None:
            if limit is not None and not size:
                return
            # As far as a chain of records needs; past the own blocks too.
            while len(marks) < 8 and (got := next(blocks, None)):
                if got[0] >= end and limit is None:
                    limit = len(buffer)
                marks.append((len(buffer), got[0]))
                buffer += got[1]
            if (at := first_record(buffer, n_refs)) is None:
                return
        starts, n, unpack = [], len(buffer), struct.Struct("<i").unpack_from
        stop = n if limit is None else min(n, limit)
        while at < stop and at + 4 <= n:
            to = at + 4 + unpack(buffer, at)[0]
            if to > n:
                break
            starts.append(at)
            at = to
        if starts:
            begins = np.array(starts, np.int64)
            places, offsets = np.array(marks, np.int64).T
            mine = np.searchsorted(places, begins, "right") - 1
            yield np.frombuffer(buffer, np.uint8), begins + 4, np.diff(np.append(begins, at)) - 4, (offsets[mine] << 16) | (begins - places[mine])
        if limit is not None and at >= limit:
            return
        if not more:
            if at < n:
                raise BamError("the last record is cut short")
            return
        keep = max((i for i, m in enumerate(marks) if m[0] <= at), default=0)
        buffer, limit = buffer[at:], None if limit is None else limit - at
        marks = [(a - at, o) for a, o in marks[keep:]]
        at = 0


class BlockWriter:
    """Records into compressed blocks, whole ones where they fit; knows the virtual offset of what comes next."""

    SIZE = 60_000

    def __init__(self, out, level: int = 6):
        self.out, self.level, self.offset, self.pending = out, level, 0, bytearray()

    def tell(self) -> int:
        return self.offset << 16 | len(self.pending)

    def flush(self) -> None:
        if self.pending:
            data = pack_blocks(bytes(self.pending), self.SIZE, self.level)
            self.out.write(data)
            self.offset += len(data)
            self.pending.clear()

    def make_room(self, n: int) -> None:
        if self.pending and len(self.pending) + n > self.SIZE:
            self.flush()

    def write(self, data: bytes) -> None:
        """Data larger than a block is packed at once, so offsets stay those of block starts."""
        self.make_room(len(data))
        self.pending += data
        if len(self.pending) > self.SIZE:
            self.flush()

    def write_records(self, data, ends):
        """Records that end at these places of data, as ``make_room`` and ``write`` place them; the virtual offsets at
        which each begins and ends."""
        import numpy as np

        begins = np.append(0, ends[:-1]) if len(ends) else ends
        starts, stops = np.empty(len(ends), np.int64), np.empty(len(ends), np.int64)
        i = 0
        while i < len(ends):
            if self.pending and len(self.pending) + ends[i] - begins[i] > self.SIZE:
                self.flush()
            # At least one record: one larger than a block is packed at once.
            j = max(i + 1, int(np.searchsorted(ends, begins[i] + self.SIZE - len(self.pending), "right")))
            here = self.tell()
            starts[i:j], stops[i:j] = here + begins[i:j] - begins[i], here + ends[i:j] - begins[i]
            self.pending += data[begins[i] : ends[j - 1]].tobytes()
            if len(self.pending) > self.SIZE:
                self.flush()
                stops[j - 1] = self.tell()
            i = j
        return starts, stops


def extent(raw: bytes) -> tuple[int, int, int, bool]:
    """Reference number, begin, end and whether the record is mapped."""
    ref, pos, n_name, _, _, n_cigar, flag = struct.unpack_from("<iiBBHHH", raw)
    at = 32 + n_name
    span = sum(c >> 4 for c in struct.unpack_from(f"<{n_cigar}I", raw, at) if OPERATIONS[c & 15] in ON_REFERENCE)
    return ref, pos, pos + max(1, span), not flag & 4


# -- data source ------------------------------------------------------------------------------------------------------


def files_of(path: str) -> list[str]:
    """The alignment files of a path: the file itself, or those of a folder in the order of their names."""
    return store.listing(path, ".bam") if store.kind(path) == "folder" else [path]


def index_of(path: str) -> Index | None:
    """The index beside a file, if there is one."""
    for suffix in (".bai", ".csi"):
        if store.kind(path + suffix) == "file":
            return Index.load(store.read(path + suffix))
    return None


class _Split(InputPartition):
    """Records that begin in blocks from start to before end, and before the virtual offset stop; inside: see records_of."""

    def __init__(self, path: str, start: int, inside: int | None, end: int, stop: int = 1 << 63):
        super().__init__((path, start, inside, end, stop))
        self.path, self.start, self.inside, self.end, self.stop = path, start, inside, end, stop


def splits_of(path: str, first: tuple[int, int], size: int, split_bytes: int) -> list[_Split]:
    """A whole file cut by bytes; first: place of the first record."""
    starts = [first[0], *range(first[0] + split_bytes, size, split_bytes)]
    return [_Split(path, a, first[1] if i == 0 else None, b) for i, (a, b) in enumerate(zip(starts, [*starts[1:], size], strict=True))]


def splits_of_places(path: str, places: list[tuple[int, int]], split_bytes: int) -> list[_Split]:
    """Ranges of virtual offsets, long ones cut by bytes."""
    out = []
    for start, stop in places:
        end = (stop >> 16) + (1 if stop & 0xFFFF else 0)
        starts = [start >> 16, *range((start >> 16) + split_bytes, end, split_bytes)]
        out += [_Split(path, a, start & 0xFFFF if i == 0 else None, b, stop) for i, (a, b) in enumerate(zip(starts, [*starts[1:], end], strict=True))]
    return out


class BamReader(DataSourceReader):
    """Options: splitBytes; mode (FAILFAST, DROP or PERMISSIVE: what happens to records without an NM tag); raw (false
    leaves out the encoded record, which only the writer needs)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        # Read once, on the driver, and sent along: names (files of a folder share them), others, first records.
        self.names: list[str] = []
        self.others: dict[str, list[str]] = {}
        self.first: dict[str, tuple[int, int]] = {}
        headers, last = Headers(), None
        for path in files_of(self.path):
            _, references, self.first[path] = headers.of(path)
            if references is not last:
                names, last = [n for n, _ in references], references
            self.names = self.names or names
            if names is not self.names and names != self.names:
                self.others[path] = names
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.mode = options.get("mode", "FAILFAST").upper()
        self.raw = options.get("raw", "true").lower() == "true"
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("reference",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, first in self.first.items():
            names = self.others.get(path, self.names)
            index = index_of(path) if self.wanted is not None else None
            if index is None:
                out += splits_of(path, first, store.size(path), self.split_bytes)
            else:
                for i, name in enumerate(names):
                    if name in self.wanted:
                        out += splits_of_places(path, index.places(i), self.split_bytes)
        return out

    def read(self, split: _Split) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from . import batches

        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ALIGNMENT.split(", "))])
        names = self.others.get(split.path, self.names)
        named = pa.array(names, pa.string())
        with store.open_in(split.path) as f:
            keep = None if self.wanted is None else np.array([i for i, n in enumerate(names) if n in self.wanted], np.int64)
            start = split.start if split.inside is not None else next_block(f, split.start, split.end)
            if start is None:
                return
            for data, starts, sizes, places in chunks_of(f, start, split.inside, split.end, len(names)):
                mine = places < split.stop
                if keep is not None:
                    mine &= np.isin(batches.field(data, starts, "<i4"), keep)
                rows = batches.columns(data, starts[mine], sizes[mine], named, self.raw, schema)
                if self.mode in ("FAILFAST", "DROP"):
                    bare = pc.and_(rows["nm"].is_null(), rows["reference"].is_valid())
                    if pc.any(bare).as_py():
                        if self.mode == "FAILFAST":
                            raise BamError(f"record {rows.filter(bare)['query_name'][0]} has no NM tag; option mode DROP leaves such records out")
                        rows = rows.filter(pc.invert(bare))
                for at in range(0, rows.num_rows, 5000):
                    yield rows.slice(at, 5000)
                if places[-1] >= split.stop:
                    return


class _Part(WriterCommitMessage):
    def __init__(self, number: int, path: str, size: int, index: Index | None):
        self.number, self.path, self.size, self.index = number, path, size, index


class BamWriter(DataSourceArrowWriter):
    """Writes the ``raw`` records under a header of the surviving references. Rows without ``raw`` are encoded as
    ``encode_alignments`` does, in the task that writes them: records then cross to Python once, as plain columns.

    The header comes from the file in option ``header``, of which option ``references`` (JSON list) names those to keep,
    or anew from option ``lengths`` (JSON list of names and lengths). Each task writes whole blocks into a file of its
    attempt and, in order ``coordinate``, the index of its part. With ``layout`` ``files`` each file is whole and has its
    index, and the commit gives it its name: only offsets pass the driver. With ``file`` the commit strings the parts
    together in order, in one pass, and joins their indexes with shifted offsets. Option ``level`` is that of the
    compression (6; 1 is quickest).
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        if store.kind(self.path) != "nothing" and not overwrite:
            raise BamError(f"{self.path} exists")
        self.whole = options.get("layout", "file") == "files"
        if "lengths" in options:
            self.references = [(n, int(length)) for n, length in json.loads(options["lengths"])]
            self.text = "".join(f"@SQ\tSN:{n}\tLN:{length}\n" for n, length in self.references)
        else:
            self.text, self.references, _ = read_header(files_of(options["header"])[0])
        self.keep = json.loads(options["references"]) if "references" in options else [n for n, _ in self.references]
        self.order = options.get("order", "unsorted")
        self.level = int(options.get("level", 6))
        self.head = pack_blocks(self._header())  # the same in all files, so made once
        self.text = ""
        self.drafts = f"{self.path.rstrip('/')}/_draft-{uuid.uuid4().hex}" if self.whole else f"{self.path}._draft-{uuid.uuid4().hex}"

    def _index(self) -> Index:
        return Index.deep_enough(max((n for _, n in self.references), default=0))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from . import batches

        context, names = TaskContext.get(), None
        kept = set(self.keep)
        stays = np.array([name in kept for name, _ in self.references], bool)
        number = np.append(np.where(stays, np.cumsum(stays) - 1, -1), -1).astype("<i4")  # the last one: of no reference
        # Attempts write apart from one another; what no commit names is deleted with the folder of drafts.
        path = f"{self.drafts}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        index = self._index() if self.order == "coordinate" else None
        with store.open_out(path) as f:
            blocks = BlockWriter(f, self.level)
            if self.whole:
                f.write(self.head)
                blocks.offset = len(self.head)
            for batch in rows:
                raw = batch.schema.get_field_index("raw")
                if raw >= 0:
                    data, ends = batches.with_sizes(batch.column(raw))
                else:
                    names = pa.array([n for n, _ in self.references], pa.string()) if names is None else names
                    found = pc.index_in(batch.column(batch.schema.get_field_index("reference")), names).fill_null(-1)
                    data, ends = batches.encode_with_sizes(*plain_record(batch, np.asarray(found).astype(np.int64)))
                if not len(ends):
                    continue
                begins = np.append(0, ends[:-1]) + 4
                for at in (0, 20):
                    batches.put(data, begins + at, number[batches.field(data, begins + at, "<i4")])
                starts, stops = blocks.write_records(data, ends)
                if index is not None:
                    index.add_all(*batches.extents(data, begins), starts, stops)
            blocks.flush()
            if self.whole:
                f.write(END_BLOCK)
        if self.whole and index is not None:
            store.write(f"{path}{index.suffix}", index.dump(len(kept)))
            index = None
        return _Part(context.partitionId(), path, blocks.offset, index)

    def _header(self) -> bytes:
        """The header's bytes, unpacked."""
        kept = set(self.keep)
        return header_bytes(reduced_header(self.text, self.keep, self.order), [r for r in self.references if r[0] in kept])

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        suffixes = (".bai", ".csi")
        if self.whole:  # parts get their names only now, so a failed attempt leaves no file that counts
            for old in [f for s in (".bam", *suffixes) for f in store.listing(self.path, s)] if store.kind(self.path) == "folder" else []:
                store.delete(old)
            for part in parts:
                name = f"{self.path.rstrip('/')}/part-{part.number:06d}.bam"
                for suffix in suffixes:
                    if store.kind(part.path + suffix) == "file":
                        store.move(part.path + suffix, name + suffix)
                store.move(part.path, name)
            if not parts:
                store.write(f"{self.path.rstrip('/')}/part-000000.bam", self.head + END_BLOCK)
        else:
            index = self._index()
            for suffix in suffixes:
                store.delete(self.path + suffix)
            with store.open_out(self.path) as out:
                out.write(self.head)
                place = len(self.head)
                for part in parts:
                    with store.open_in(part.path) as f:
                        while chunk := f.read(8 << 20):
                            out.write(chunk)
                    if part.index is not None:
                        index.absorb(part.index, place)
                    place += part.size
                out.write(END_BLOCK)
            if self.order == "coordinate":
                store.write(f"{self.path}{index.suffix}", index.dump(len(self.keep)))
        store.delete(self.drafts)

    def abort(self, messages: list) -> None:
        store.delete(self.drafts)


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ALIGNMENT

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BamWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known and let filters on ``reference`` reach the reader."""
    ship(spark)
    spark.dataSource.register(BamDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """The header's references."""
    _, references, _ = read_header(files_of(path)[0])
    return spark.createDataFrame([(n, length, i) for i, (n, length) in enumerate(references)], REFERENCES)


def has_indexes(path: str) -> bool:
    """Whether every file of the path has its index beside it."""
    return all(any(store.kind(file + suffix) == "file" for suffix in (".bai", ".csi")) for file in files_of(path))


def index_counts(spark: SparkSession, path: str) -> DataFrame:
    """reference, n_mapped, n_unmapped of the references with records, from the indexes beside the files: no record is
    read. Files without an index are an error."""
    ship(spark)
    files = files_of(path)
    for file in files:
        if not any(store.kind(file + suffix) == "file" for suffix in (".bai", ".csi")):
            raise BamError(f"{file} has no index")
    _, references, _ = read_header(files[0])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file in batch.column(0).to_pylist():
                index = index_of(file)
                rows = [(ref, r.mapped, r.unmapped) for ref, r in index.references.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)], ["number", "mapped", "unmapped"])

    # Each index is read in a task; a row for each reference and file is summed.
    counts = spark.createDataFrame([(f,) for f in files], "file string").repartitionByRange(len(files), "file").mapInArrow(run, "number bigint, mapped bigint, unmapped bigint")
    names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(references)], "number bigint, reference string")
    summed = counts.groupBy("number").agg(F.sum("mapped").alias("n_mapped"), F.sum("unmapped").alias("n_unmapped"))
    return summed.join(names, "number").select("reference", "n_mapped", "n_unmapped")


def inspect(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, with_index: bool = True) -> DataFrame:
    """file, start, records, first, last (places as [reference number, position]), ordered, error, index (its bytes) of
    every split of every file that has a header; all of it is found in tasks. index is NULL if it isn't asked for."""
    ship(spark)
    splits = []
    headers, last = Headers(), None
    for file in files_of(path):
        try:
            _, references, first = headers.of(file)
        except (BamError, struct.error):
            continue
        if references is not last:
            longest, last = max((n for _, n in references), default=0), references
        splits += [(file, s.start, s.inside, s.end, len(references), longest) for s in splits_of(file, first, store.size(file), split_bytes)]
    columns = "file string, start bigint, inside bigint, end bigint, n_refs bigint, longest bigint"
    out = "file string, start bigint, records bigint, first array<bigint>, last array<bigint>, ordered boolean, error string, index binary"

    def run(rows):
        import numpy as np
        import pyarrow as pa

        from . import batches

        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("records", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("ordered", pa.bool_()), ("error", pa.string()), ("index", pa.binary())])
        for batch in rows:
            for s in batch.to_pylist():
                index, n, first, last, ordered, error, open_ = Index.deep_enough(s["longest"]), 0, None, None, True, None, None
                try:
                    with store.open_in(s["file"]) as f:
                        start = s["start"] if s["inside"] is not None else next_block(f, s["start"], s["end"])
                        for data, starts, _, places in chunks_of(f, start, s["inside"], s["end"], s["n_refs"]) if start is not None else ():
                            where = batches.extents(data, starts)
                            refs, begins = np.where(where[0] >= 0, where[0], s["n_refs"]), where[1]
                            up = (refs[1:] > refs[:-1]) | ((refs[1:] == refs[:-1]) & (begins[1:] >= begins[:-1]))
                            key = [int(refs[0]), int(begins[0])]
                            ordered = bool(ordered and up.all() and (last is None or last <= key))
                            first, last, n = first or key, [int(refs[-1]), int(begins[-1])], n + len(starts)
                            if with_index:  # a record ends where the next one begins
                                if open_:
                                    index.add_all(*open_[0], open_[1], places[:1])
                                index.add_all(*(x[:-1] for x in where), places[:-1], places[1:])
                                open_ = [x[-1:] for x in where], places[-1:]
                        if open_:
                            # The last record ends where the next split's blocks begin, or before.
                            index.add_all(*open_[0], open_[1], np.maximum(s["end"] << 16, open_[1] + 1))
                except (BamError, struct.error, ValueError, IndexError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_pylist([{"file": s["file"], "start": s["start"], "records": n, "first": first, "last": last, "ordered": ordered, "error": error, "index": index.dump(s["n_refs"]) if with_index else None}], schema)

    if not splits:
        return spark.createDataFrame([], out)
    return spark.createDataFrame(splits, columns).repartitionByRange(len(splits), "file", "start").mapInArrow(run, out)


def check_input(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> list[tuple[str, str]]:
    """(file, state) of each file: ok, or the first of

    ``empty`` (no byte), ``no header`` (not such a file, or cut within its header), ``no references``, ``truncated`` (a
    block or record is cut, or the empty block at the end is missing), ``no records``, ``unsorted`` (the header says
    coordinate, the records don't), ``other order`` (the header doesn't say coordinate: an index can't be built).
    """
    found: dict[str, list] = {}
    for r in inspect(spark, path, split_bytes, False).drop("index").orderBy("file", "start").collect():  # a row per split
        found.setdefault(r["file"], []).append(r)
    out, headers = [], Headers()
    for file in files_of(path):
        size = store.size(file)
        if not size:
            out.append((file, "empty"))
            continue
        try:
            text, references, _ = headers.of(file)
        except (BamError, struct.error):
            out.append((file, "no header"))
            continue
        with store.open_in(file) as f:
            f.seek(max(0, size - len(END_BLOCK)))
            closed = f.read(len(END_BLOCK)) == END_BLOCK
        rows = [r for r in found.get(file, []) if r["records"] or r["error"]]
        full = [r for r in rows if r["records"]]
        ordered = all(r["ordered"] for r in full) and all(list(a["last"]) <= list(b["first"]) for a, b in zip(full, full[1:], strict=False))
        says = any(line.startswith("@HD") and "SO:coordinate" in line.split("\t") for line in text.splitlines())
        state = "no references" if not references else "truncated" if not closed or any(r["error"] for r in rows) else "no records" if not full else "unsorted" if says and not ordered else "other order" if not says else "ok"
        out.append((file, state))
    return out


def build_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> None:
    """Write the index of each file of the path: tasks index their splits, only offsets pass the driver."""
    found: dict[str, list] = {}
    for r in inspect(spark, path, split_bytes).orderBy("file", "start").collect():
        if r["error"]:
            raise BamError(f"{r['file']}: {r['error']}")
        if not r["ordered"]:
            raise BamError(f"{r['file']} is not in the order of places")
        found.setdefault(r["file"], []).append(r)
    for file, rows in found.items():
        _, references, _ = read_header(file)
        index = Index.deep_enough(max((n for _, n in references), default=0))
        for r in rows:
            index.absorb(Index.load(bytes(r["index"])))
        store.write(f"{file}{index.suffix}", index.dump(len(references)))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of the files that Spark's own reader finds under path (each file is one task)."""

    def run(batches):
        import pandas as pd

        columns = [c.split()[0] for c in ALIGNMENT.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                at, parts = 0, []
                while at + BLOCK_HEAD <= len(content):
                    size = block_size(content[at : at + BLOCK_HEAD])
                    parts.append(unpack_block(content[at : at + size]))
                    at += size
                data = b"".join(parts)
                _, references, at = parse_header(data) or ("", [], len(data))
                names, rows = [n for n, _ in references], []
                while at + 4 <= len(data):
                    (size,) = struct.unpack_from("<i", data, at)
                    rows.append(parse_record(data[at + 4 : at + 4 + size], names))
                    at += 4 + size
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ALIGNMENT)


def sort_alignments(alignments: DataFrame, references: DataFrame, by_name: bool = False) -> DataFrame:
    """Records by place (references in header order) or by read name, as the writer strings parts together."""
    from pyspark.sql import functions as F

    if by_name:
        return alignments.orderBy("query_name", "flag")
    order = references.select("reference", "header_order")
    joined = alignments.join(order, "reference", "left")
    return joined.orderBy(F.col("header_order").asc_nulls_last(), "reference_start").drop("header_order")


def encode_record(name: str, ref: int, pos: int, cigar: list[tuple[int, str]], sequence: str, tags: dict[str, int], flag: int = 0, mapq: int = 60, mate: tuple[int, int] = (-1, -1)) -> bytes:
    """A record without its size (for fixtures and conversions)."""
    ops = b"".join(struct.pack("<I", n << 4 | OPERATIONS.index(op)) for n, op in cigar)
    codes = [BASES.index(b) for b in sequence]
    packed = bytes(codes[i] << 4 | (codes[i + 1] if i + 1 < len(codes) else 0) for i in range(0, len(codes), 2))
    fields = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(sequence), mate[0], mate[1], 0)
    extra = b"".join(k.encode() + b"i" + struct.pack("<i", v) for k, v in tags.items())
    return fields + name.encode() + b"\0" + ops + packed + b"\xff" * len(sequence) + extra


#: Columns of alignments that have no encoded form yet.
PLAIN = ("query_name", "reference", "reference_start", "query_alignment_length", "is_reverse", "mapping_quality", "nm", "as_score", "xo", "xg")


def plain_record(batch, numbers) -> tuple:
    """The arguments of ``batches.encode`` for a batch with the columns ``PLAIN``; numbers: of the references."""
    import numpy as np

    c = {k: batch.column(batch.schema.get_field_index(k)) for k in PLAIN}
    whole = lambda name, null: np.asarray(c[name].fill_null(null)).astype(np.int64)
    missing = [k for k in ("query_name", "query_alignment_length", "mapping_quality") if c[k].null_count]
    if missing:
        raise BamError(f"records without {', '.join(missing)}")
    reverse = np.asarray(c["is_reverse"].fill_null(False)).astype(bool)
    tags = {tag.decode(): c[k] for tag, k in TAGS.items()}
    return c["query_name"], numbers, whole("reference_start", -1), whole("query_alignment_length", 0), reverse, whole("mapping_quality", 0), tags


def encode_alignments(alignments: DataFrame, references: DataFrame, by_place: bool = False) -> DataFrame:
    """query_name, reference, reference_start and raw: records of alignments that have no encoded form yet.

    alignments: query_name, reference, reference_start, query_alignment_length, is_reverse, mapping_quality, nm, as_score,
    xo, xg; references: reference, header_order. A record is one stretch of matches without a sequence.
    by_place: in the order of references and starts.
    """
    ship(alignments.sparkSession)
    columns = ["query_name", "reference", "header_order", "reference_start", *PLAIN[3:]]

    def run(rows):
        import numpy as np
        import pyarrow as pa

        from . import batches

        for batch in rows:
            raws = batches.encode(*plain_record(batch, np.asarray(batch.column(2).fill_null(-1)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), raws], ["query_name", "reference", "header_order", "reference_start", "raw"])

    joined = alignments.join(references.select("reference", "header_order"), "reference", "left").select(*columns)
    if by_place:  # plain columns are sorted, and encoded once: sorting looks at its input twice
        joined = joined.orderBy("header_order", "reference_start")
    return joined.mapInArrow(run, "query_name string, reference string, header_order int, reference_start bigint, raw binary")
