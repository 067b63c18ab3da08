"""WARC archives: write captures, read records back, and assemble transactions.

A capture is a request, a response (or, where an equal payload is stored elsewhere, a revisit) and a metadata record;
request and metadata name the record they belong to in WARC-Concurrent-To. Archives are ``*.warc.gz`` files, each begun
by a warcinfo record, in which every record is a gzip member of its own and so can be read by its offset. Spark's text
writer writes them, so they can lie in any store that Spark reaches and failed attempts leave nothing: a row is a bundle
of members that ends in a zero byte, and that byte is the writer's line separator. Files are cut by bytes.

``read_archives`` and ``read_records`` take these or any other files of WARC records, plain or gzip members of any cut. A
file is read as a stream by one task, member by member: memory holds one record, whatever the size of the file.

Defined cases: a null payload counts as empty; payloads of any size are one record; equal payloads under the least
size are all stored; rows that repeat a key with another payload or address are captures of their own, and wholly equal
rows give equal captures, as many as there are rows; a null key is a capture without key, lower than any other;
records without a partner give a capture with nulls (requests and metadata alone are left out); damaged records and
unknown record types are skipped, and reading goes on at the next record or gzip member; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from .runtime import BATCH_ROWS, Scratch, prepare

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A bundle of members ends at so many compressed bytes; a file holds so many bundles.
BUNDLE_BYTES = 4 << 20
BUNDLES = 32
#: Bytes read from a store at once, given to the unpacker at once, and in a batch of records.
CHUNK = 1 << 20
FEED = 1 << 14
BATCH = 8 << 20
#: Longer heads of a record are damage.
HEAD = 1 << 20
MAGIC = b"\x1f\x8b\x08"
#: Tables of shared payloads are broadcast up to this number of rows, and shuffled beyond.
BROADCAST_ROWS = 1_000_000
END = b"\r\n\r\n"


def record_id(kind: str, *identity: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr((kind, *identity)).encode()).digest())}>"


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    """One record without the two empty lines after it."""
    lines = [VERSION, f"WARC-Type: {kind}".encode()]
    lines += [f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}".encode() for k, v in headers.items() if v is not None]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def member(plain: bytes) -> bytes:
    """plain as one gzip member (the same bytes each time)."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


#: The gzip member of nothing; it ends in a zero byte, as all members of less than 16 MB do.
NOTHING = member(b"")


def plain_pieces(read: Callable[[int], bytes]) -> Iterator[tuple[bytes | None, bool]]:
    """(piece of the plain bytes, whether it is at a gzip member's border); None for damage, after which the next member is
    looked for."""
    data, at = read(CHUNK), 0
    if data[:2] != MAGIC[:2]:
        while data:
            yield data, False
            data = read(CHUNK)
        return
    while True:
        unpacker, first, early = zlib.decompressobj(31), True, b""
        try:
            while not unpacker.eof:
                if at == len(data):
                    data, at = read(CHUNK), 0
                window = data[at : at + FEED]
                piece = unpacker.decompress(window, CHUNK) if window else unpacker.flush()
                at += len(window) - len(unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail)
                # The first piece of a member shows whether a record begins there.
                early += piece
                if early and (not first or len(early) >= 5 or unpacker.eof or not window):
                    yield early, first
                    first, early = False, b""
                if not window and not unpacker.eof:
                    return  # cut short
        except zlib.error:
            yield None, False
            at += 1
            while (found := data.find(MAGIC, at)) == -1:
                more = read(CHUNK)
                if not more:
                    return
                data, at = data[-2:] + more, 0
            at = found
            continue
        yield b"", True  # the member's checksum holds
        # Zero bytes may fill the space between members.
        while True:
            while at < len(data) and data[at] == 0:
                at += 1
            if at < len(data):
                break
            data, at = read(CHUNK), 0
            if not data:
                return


def records_of(pieces: Iterator[tuple[bytes | None, bool]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each whole record; after damage the next record is looked for.

    A record that a member has begun and that is not whole where another member begins with a record is damaged. The
    last record of a member waits for the member's end, as its checksum may not hold.
    """
    held, need, waiting = bytearray(), 0, []

    def whole(last: bool) -> Iterator[tuple[dict[str, str], bytes]]:
        nonlocal need
        need, at = 0, 0
        while (begin := held.find(b"WARC/", at)) != -1:
            at = begin
            head_end = held.find(b"\r\n\r\n", at, at + HEAD)
            if head_end == -1:
                if not last and len(held) < at + HEAD:
                    break
                at += 5
                continue
            headers = {}
            for line in bytes(held[at:head_end]).split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
            length = headers.get("content-length", "")
            start = head_end + 4
            if not (length.isascii() and length.isdigit()) or (last and start + int(length) > len(held)):
                at += 5
                continue
            if start + int(length) > len(held):
                need = start + int(length) - at
                break
            block = bytes(held[start : start + int(length)])
            at = start + int(length)
            yield headers, block
        else:
            at = max(at, len(held) - 4)  # the name may be cut
        del held[: len(held) if last else at]

    def found(last: bool) -> Iterator[tuple[dict[str, str], bytes]]:
        for r in whole(last):
            yield from waiting
            waiting[:] = [r]

    for piece, border in pieces:
        if piece is None:
            held.clear()
            waiting.clear()
            need = 0
            continue
        if border:
            if piece[:5] == b"WARC/":
                yield from found(True)
            yield from waiting
            waiting.clear()
        held += piece
        if len(held) >= need:
            yield from found(False)
    yield from found(True)
    yield from waiting


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``records_of`` bytes at hand."""
    return records_of(plain_pieces(io.BytesIO(data).read))


def http_payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def write_archives(captures: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Write all captures (request, response or revisit, metadata) as WARC files and return their folder.

    Of equal payloads of REVISIT_BYTES or more the one with the largest key is the response that the others revisit.
    """
    spark = captures.sparkSession
    prepare(spark)
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    ready = captures.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), data.alias("data"))
    ready = ready.withColumn("digest", F.sha1("data")).withColumn("n", F.octet_length("data"))
    # The keeper of a payload is a row, so a key that another payload repeats is no keeper of it.
    row = F.struct(F.col("k"), F.coalesce("u", F.lit("")).alias("u"))
    keepers = ready.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n").agg(F.max(row).alias("keeper"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    keepers = Scratch.table(keepers, "warc-keepers")
    keepers = F.broadcast(keepers) if keepers.count() <= BROADCAST_ROWS else keepers
    marked = ready.join(keepers, ["digest", "n"], "left").withColumn("own", row)
    away = F.col("keeper").isNotNull() & (F.col("keeper.k").isNotNull()) & (F.col("own") < F.col("keeper"))
    marked = marked.select("k", "u", "data", "digest", F.when(away, F.col("keeper.k")).alias("keeper"), F.col("keeper.u").alias("keeper_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def bundle() -> pa.RecordBatch:
            joined = b"".join(parts)
            joined = joined if joined[-1] == 0 else joined + NOTHING
            return pa.RecordBatch.from_arrays([pa.array([joined[:-1]], pa.binary())], ["data"])

        for batch in batches:
            for capture in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts and number % BUNDLES == 0:
                    parts.append(member(information(f"{task}-{number // BUNDLES}") + END))
                packed = [member(r + END) for r in capture_records(*capture)]
                parts += packed
                size += sum(map(len, packed))
                if size >= BUNDLE_BYTES:
                    yield bundle()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield bundle()

    folder = Scratch.folder(spark, "warc")
    # A row is a bundle; its bytes pass the text writer as they are, and the line separator is its last byte.
    texts = marked.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
    texts.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", BUNDLES).text(folder)
    name_archives(spark, folder)
    return folder


def name_archives(spark: SparkSession, folder: str) -> None:
    """Give the text writer's files (whole once its job has ended) the name of what they hold."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in [f.getPath().getName() for f in files.listStatus(path(folder))]:
        if name.endswith(".txt"):
            files.rename(path(folder, name), path(folder, name.removesuffix(".txt") + ".warc.gz"))


def information(name: str) -> bytes:
    block = b"software: readloom\r\nformat: WARC File Format 1.1\r\n"
    return record("warcinfo", {"WARC-Record-ID": record_id("warcinfo", name), "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, block)


def capture_records(key: int | None, url: str | None, body: bytes, digest: str, keeper: int | None = None, keeper_url: str | None = None) -> list[bytes]:
    """The three records of one capture."""
    target = url or f"urn:page:{key}"
    main = record_id("response", key, url or "", digest)
    common = {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": target}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    own = {"WARC-Record-ID": main, **common, "WARC-Payload-Digest": f"sha1:{digest}", "X-Capture-Key": key, "Content-Type": "application/http; msgtype=response"}
    if keeper is None:
        stored = record("response", own, head + body)
    else:
        own |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id("response", keeper, keeper_url, digest), "X-Refers-To-Key": keeper, "X-Payload-Length": len(body)}
        stored = record("revisit", own, head)
    get = f"GET {target} HTTP/1.1\r\nHost: archive\r\n\r\n".encode()
    request = record("request", {"WARC-Record-ID": record_id("request", main), **common, "WARC-Concurrent-To": main, "Content-Type": "application/http; msgtype=request"}, get)
    metadata = record("metadata", {"WARC-Record-ID": record_id("metadata", main), **common, "WARC-Concurrent-To": main, "Content-Type": "application/warc-fields"}, f"payloadBytes: {len(body)}\r\n".encode())
    return [request, stored, metadata]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path of each WARC file of a folder, in partitions of Spark's usual size. Where tasks can't open the folder's store
    by ranges, data instead: the files' bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    try:
        store.of(folder)
    except (OSError, ValueError, NotImplementedError):  # no such store, or no client library
        return files.select(F.col("content").alias("data"))
    return files.select("path")


RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, url string, date string, capture_key bigint, "
    "refers_to_key bigint, payload_bytes bigint, payload_digest string, block binary"
)


def read_records(files: DataFrame, with_blocks: bool = True) -> DataFrame:
    """The records of WARC files: of the first column, ``path`` (read as a stream) or ``data`` (bytes; null: none)."""
    prepare(files.sparkSession)
    by_path = files.columns[0] == "path"
    fields = [c.split() for c in RECORDS.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in fields])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def number(x: str | None) -> int | None:
        return int(x) if x is not None and x.lstrip("-").isdigit() else None

    def row_of(h: dict[str, str], kind: str, block: bytes) -> tuple:
        if kind == "response":
            payload = http_payload(block)
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        elif kind == "revisit":
            size, digest = number(h.get("x-payload-length")), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        else:
            size, digest = len(block), None
        names = ("warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date")
        ident, partner, refers, url, date = (h.get(n) for n in names)
        return ident, kind, partner, refers, url, date, number(h.get("x-capture-key")), number(h.get("x-refers-to-key")), size, digest, block if with_blocks else None

    def batches_of(file) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for h, block in records_of(plain_pieces(file.read)):
            kind = h.get("warc-type", "")
            if kind not in ("request", "response", "revisit", "metadata"):
                continue
            rows.append(row_of(h, kind, block))
            size += len(block) if with_blocks else 0
            if len(rows) >= BATCH_ROWS or size >= BATCH:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                with store.open_in(value) if by_path else io.BytesIO(value or b"") as file:
                    yield from batches_of(file)

    return files.select("path" if by_path else F.col("data").cast("binary")).mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response (or revisit), request, metadata, n_requests, n_metadata.

    Records join through the identifier that they are concurrent to. Of several requests or metadata records of one
    capture the one with the least identifier is shown and all are counted, so no capture gathers a group of any size.
    Captures with one identifier (those of equal rows) come out as often as they were written.
    """
    main = F.col("type").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))
    row = F.struct("record_id", "type", "refers_to", "url", "date", "capture_key", "refers_to_key", "payload_bytes", "payload_digest", "block")
    part = lambda cond: F.min(F.when(cond, row))
    grouped = records.withColumn("capture", key).filter(F.col("capture").isNotNull()).groupBy("capture").agg(
        part(main).alias("response"),
        part(F.col("type") == "request").alias("request"),
        part(F.col("type") == "metadata").alias("metadata"),
        F.count(F.when(main, 1)).alias("times"),
        F.count(F.when(F.col("type") == "request", 1)).alias("n_requests"),
        F.count(F.when(F.col("type") == "metadata", 1)).alias("n_metadata"),
    )
    each = lambda c: F.ceil(F.col(c) / F.col("times")).cast("long").alias(c)
    written = grouped.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return written.select(F.col("capture").alias("record_id"), "response", "request", "metadata", each("n_requests"), each("n_metadata"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read them back, assemble the captures: one row per page."""
    captures = assemble(read_records(read_archives(pages.sparkSession, write_archives(pages)), with_blocks=False))
    r = "response."
    return captures.select(F.col(r + "capture_key").alias("page_id"), F.col(r + "payload_bytes").alias("payload_bytes"), F.col(r + "payload_digest").alias("payload_digest"), F.col(r + "type").alias("record_type"), F.col(r + "refers_to_key").alias("refers_to"), F.col(r + "url").alias("url"), "n_requests", "n_metadata", F.col("metadata.payload_bytes").alias("metadata_bytes"))
