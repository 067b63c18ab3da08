"""Results as files: tables with tabs, JSON, names of outputs.

A result is one named file, as users of the command line expect, but no task writes it alone: Spark sorts and writes
parts, and the commit joins them under the name, by the store's own concatenation where it has one and else in one pass
over the (compressed) parts. The file appears only when it is whole. ``one_file=False`` leaves a folder of parts.
"""

from __future__ import annotations

import gzip
import uuid
from pathlib import PurePosixPath

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

COPY = 8 << 20


def _joined_by_store(spark: SparkSession, target: str, parts: list[str]) -> bool:
    """Append the parts to the target without reading them; false where the store can't."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    sources = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
    for i, part in enumerate(parts):
        sources[i] = jvm.org.apache.hadoop.fs.Path(part)
    try:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).concat(path, sources)
    except (Py4JError, PySparkException):
        return False
    return True


def join_parts(spark: SparkSession, folder: str, path: str, head: bytes) -> None:
    """head and the part files of a folder, in order, as one file; the folder goes."""
    parts = [p for p in store.listing(folder) if store.size(p)]
    draft = f"{path}._draft-{uuid.uuid4().hex}"
    store.write(draft, head)
    if not (parts and head and "://" in path and _joined_by_store(spark, draft, parts)):
        with store.open_out(draft) as out:
            out.write(head)
            for part in parts:
                with store.open_in(part) as f:
                    while chunk := f.read(COPY):
                        out.write(chunk)
    store.delete(path)
    store.move(draft, path)
    store.delete(folder)


def _write(df: DataFrame, path: str, order: tuple[Column | str, ...], table: bool, one_file: bool, blank: bool) -> None:
    zipped = path.endswith(".gz")
    ordered = df.orderBy(*order) if order else df
    folder = f"{path}._parts-{uuid.uuid4().hex}" if one_file else path
    writer = ordered.write.mode("overwrite").option("compression", "gzip" if zipped else "none")
    if table:
        writer.option("sep", "\t").option("header", not one_file).csv(folder)
    else:
        writer.text(folder)
    if not one_file:
        return
    if blank and df.isEmpty():
        store.delete(folder)
        store.delete(path)
        store.write(path, b"")
        return
    head = ("\t".join(df.columns) + "\n").encode() if table else b""
    join_parts(df.sparkSession, folder, path, gzip.compress(head) if zipped and head else head)


def write_tsv(df: DataFrame, path: str, order: tuple[Column | str, ...] = (), one_file: bool = True, blank: bool = False) -> None:
    """A table with a header, gzipped if its name says so. blank: a table without rows is an empty file, header and all."""
    _write(df, path, order, True, one_file, blank)


def write_read_hits(hits: DataFrame, path: str) -> None:
    """Reads by falling count."""
    _write(hits, path, (F.desc("count"), "read"), True, True, False)


def write_read_length_freqs(freqs: DataFrame, path: str) -> None:
    """One JSON object per reference: {reference: {length: [...], freq: [...]}}."""
    entry = F.to_json(F.create_map(F.col("reference"), F.struct("length", "freq")))
    _write(freqs.select(entry.alias("value")), path, ("value",), False, True, False)


def write_empty(paths: list[str]) -> None:
    """What an input without records leaves behind: empty files, and alignment files of an empty header. Files that are
    there already stay."""
    from .bam import END_BLOCK, header_bytes, pack_blocks

    for path in paths:
        if store.kind(path) == "nothing":
            store.write(path, pack_blocks(header_bytes("@HD\tVN:1.0\tSO:unsorted\n", [])) + END_BLOCK if path.endswith(".bam") else b"")


def output_names(bam: str, prefix: str | None = None) -> dict[str, str]:
    """Default names of all outputs, after a prefix or the stem of the alignment file."""
    stem = prefix or PurePosixPath(bam).name.removesuffix(".bam")
    return {
        "stats": f"{stem}_stats.tsv.gz",
        "stats_filtered": f"{stem}_stats-filtered.tsv.gz",
        "bam_filtered": f"{stem}.filtered.bam",
        "bam_reassigned": f"{stem}.reassigned.bam",
        "read_length_freqs": f"{stem}_read-length-freqs.json",
        "read_hits_count": f"{stem}_read-hits-count.tsv.gz",
        "coverage": f"{stem}_coverage",
        "knee": f"{stem}_knee",
        "lca_summary": f"{stem}_lca-summary.tsv.gz",
    }
