import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import In

from readloom import cli
from readloom.operators import align
from readloom.sources import bam


def write(path, n=400, block=3000):
    rng = random.Random(2)
    references = [("c1", 5000), ("c2", 4000)]
    text = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:c1\tLN:5000\n@SQ\tSN:c2\tLN:4000\n"
    records = []
    for i in range(n):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randrange(30, 90)))
        cigar = [(5, "S"), (10, "M"), (2, "D"), (3, "I"), (len(seq) - 18, "M"), (4, "H")]
        tags = {"NM": i % 4, "AS": 40} | ({"XO": 1} if i % 2 else {})
        records.append(bam.encode_record(f"read{i % 90}", i % 2 if i % 50 else -1, rng.randrange(0, 3000) if i % 50 else -1, cigar if i % 50 else [], seq, tags, flag=16 if i % 3 == 0 else 0))
    data = bam.header_bytes(text, references) + b"".join(len(r).to_bytes(4, "little") + r for r in records)
    path.write_bytes(bam.pack_blocks(data, block) + bam.END_BLOCK)
    return records


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = tmp_path_factory.mktemp("bam") / "x.bam"
    return path, write(path)


def test_splits_find_every_record_once(spark, file):
    path, records = file
    bam.register(spark)
    df = spark.read.format("bam").option("splitBytes", 4000).load(str(path))
    assert df.rdd.getNumPartitions() > 4
    assert sorted(bytes(r.raw) for r in df.select("raw").collect()) == sorted(records)


def test_derived_lengths(spark, file):
    path, _ = file
    bam.register(spark)
    r = spark.read.format("bam").load(str(path)).filter("query_name = 'read1'").first()
    n = r.query_length
    assert (r.inferred_query_length, r.inferred_read_length, r.query_alignment_length) == (n, n + 4, n - 5)
    assert r.reference_end - r.reference_start == 10 + 2 + n - 18 and r.nm == 1 and r.xo == 1 and r.xg is None
    assert len(r.query_sequence) == n and r.cigar.startswith("5S10M2D3I")
    assert spark.read.format("bam").load(str(path)).filter("reference is null").count() == 8


def test_pushed_filter_and_other_reader(spark, file):
    path, records = file
    bam.register(spark)
    df = spark.read.format("bam").load(str(path))
    assert df.filter("reference = 'c2'").count() == sum(r[:4] == b"\1\0\0\0" for r in records)
    assert bam.read_binary(spark, str(path)).count() == len(records)
    assert [tuple(r) for r in bam.read_references(spark, str(path)).collect()] == [("c1", 5000, 0), ("c2", 4000, 1)]


def test_write_back_with_fewer_references(spark, file, tmp_path):
    path, _ = file
    bam.register(spark)
    df = spark.read.format("bam").load(str(path)).filter("reference = 'c2'")
    out = str(tmp_path / "out.bam")
    ordered = bam.sort_alignments(df, bam.read_references(spark, str(path)))
    ordered.write.format("bam").mode("overwrite").option("header", str(path)).option("references", json.dumps(["c2"])).option("order", "coordinate").save(out)
    back = spark.read.format("bam").load(out)
    starts = [r[0] for r in back.select("reference_start").collect()]
    assert starts == sorted(starts) and len(starts) == df.count()
    assert {r[0] for r in back.select("reference").distinct().collect()} == {"c2"}
    text, references, _ = bam.read_header(out)
    assert references == [("c2", 4000)] and "SO:coordinate" in text and "SN:c1" not in text


def test_folder_of_files(spark, file, tmp_path):
    path, records = file
    bam.register(spark)
    out = str(tmp_path / "parts")
    df = spark.read.format("bam").option("splitBytes", 4000).load(str(path))
    for _ in range(2):
        df.write.format("bam").mode("overwrite").option("header", str(path)).option("layout", "files").save(out)
    assert len(bam.files_of(out)) == df.rdd.getNumPartitions() > 4
    back = spark.read.format("bam").option("splitBytes", 2000).load(out)
    assert sorted(bytes(r.raw) for r in back.collect()) == sorted(records)
    assert bam.read_references(spark, out).count() == 2 and bam.read_binary(spark, out + "/*.bam").count() == len(records)
    assert spark.read.format("bam").option("raw", "false").load(out).filter("raw is not null").count() == 0


def test_next_block(tmp_path):
    data = bam.pack_blocks(bytes(range(256)) * 40 + b"\x1f\x8b\x08\x04" * 50, 700) + bam.END_BLOCK
    (tmp_path / "b").write_bytes(data)
    with open(tmp_path / "b", "rb") as f:
        starts = [at for at, _ in bam.read_blocks(f, 0)]
        for at in range(0, len(data), 97):
            assert bam.next_block(f, at, len(data)) == next((x for x in starts if x >= at), None)
        assert bam.next_block(f, starts[3] + 1, starts[4]) is None


def test_not_a_bam(tmp_path):
    (tmp_path / "x.bam").write_bytes(b"nothing here at all")
    with pytest.raises(bam.BamError):
        bam.read_header(str(tmp_path / "x.bam"))


def test_command_line(spark, file, tmp_path):
    from readloom import cli

    path, _ = file
    out = lambda name: str(tmp_path / name)
    assert cli.main(["filter", "--bam", str(path), "--stats", out("s.tsv.gz"), "--stats-filtered", out("f.tsv"), "--bam-filtered", out("f.bam"), "--read-hits-count", out("h.tsv"), "--read-length-freqs", out("l.json"), "-A", "80", "-a", "80"]) == 0
    stats = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "s.tsv.gz"))
    assert len(stats.columns) == 42 and stats.count() == 2
    assert (tmp_path / "f.bam").exists() and spark.read.text(str(tmp_path / "l.json")).count() == 2
    assert cli.main(["reassign", "--bam", str(path), "-o", out("r.bam"), "-A", "80"]) == 0
    assert bam.read_header(str(tmp_path / "r.bam"))[1] == [("c1", 5000), ("c2", 4000)]
    for wrong in (["filter"], [], ["--version"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)


# -- index ------------------------------------------------------------------------------------------------------------


def written(spark, path, tmp_path, name, **options):
    bam.register(spark)
    out = f"file://{tmp_path}/{name}"
    df = spark.read.format("bam").load(str(path))
    ordered = bam.sort_alignments(df, bam.read_references(spark, str(path)))
    writer = ordered.write.format("bam").mode("overwrite").option("header", str(path)).option("order", "coordinate")
    writer.options(**options).save(out)
    return out


def reader(path, *names, **options):
    r = bam.BamReader({"path": path, **options})
    if names:
        assert list(r.pushFilters([In(("reference",), names)])) == []
    return r


def rows_of(r):
    return [x for split in r.partitions() for batch in r.read(split) for x in batch.column("raw").to_pylist()]


@pytest.mark.parametrize("layout", ["file", "files"])
def test_filter_opens_only_its_blocks(spark, file, tmp_path, layout):
    path, records = file
    out = written(spark, path, tmp_path, f"{layout}.bam", layout=layout)
    every = reader(out)
    assert sorted(rows_of(every)) == sorted(records)
    one = reader(out, "c1")
    splits = one.partitions()
    total = sum(s.end - s.start for s in every.partitions())
    assert 0 < sum(s.end - s.start for s in splits) < 0.8 * total
    want = sorted(r for r in records if r[:4] == b"\0\0\0\0")
    assert sorted(rows_of(one)) == want
    # every record within the ranges but for the last block of each belongs to the reference
    opened = [raw for s in splits for place, raw in bam.records_of(bam.store.open_in(s.path), s.start, s.inside, s.end, 2) if place < s.stop]
    assert sorted(opened) == want
    assert reader(out, "c9").partitions() == []
    assert spark.read.format("bam").load(out).filter("reference = 'c2'").count() == sum(r[:4] == b"\1\0\0\0" for r in records)
    counts = {r.reference: (r.n_mapped, r.n_unmapped) for r in bam.index_counts(spark, out).collect()}
    assert counts == {"c1": (len(want), 0), "c2": (sum(r[:4] == b"\1\0\0\0" for r in records), 0)}


def test_regions_against_all_records(spark, file, tmp_path):
    path, _ = file
    out = written(spark, path, tmp_path, "r.bam")
    index = bam.index_of(out)
    assert index.suffix == ".bai" and bam.Index.load(index.dump(2)).dump(2) == index.dump(2)
    with bam.store.open_in(out) as f:
        records = list(bam.records_of(f, *bam.read_header(out)[2], bam.store.size(out), 2))
    rng = random.Random(1)
    for ref in (0, 1):
        for _ in range(20):
            a = rng.randrange(3000)
            b = a + rng.randrange(1, 400)
            places = index.places(ref, a, b)
            for place, raw in records:
                r, start, end, _ = bam.extent(raw)
                if r == ref and start < b and end > a:
                    assert any(x <= place < y for x, y in places)


def test_index_of_parts_equals_index_of_the_file(spark, file, tmp_path):
    """Built anew from small splits, the index leads to the same records; long references get the deeper form."""
    path, records = file
    out = written(spark, path, tmp_path, "p.bam")
    before = bam.index_of(out)
    bam.store.delete(out + ".bai")
    with pytest.raises(bam.BamError):
        bam.index_counts(spark, out)
    bam.build_index(spark, out, 3000)
    after = bam.index_of(out)
    assert {i: (r.mapped, r.unmapped, r.windows) for i, r in before.references.items()} == {i: (r.mapped, r.unmapped, r.windows) for i, r in after.references.items()}
    assert before.placeless == after.placeless == sum(r[:4] == b"\xff\xff\xff\xff" for r in records)
    assert sorted(rows_of(reader(out, "c2", splitBytes=2000))) == sorted(r for r in records if r[:4] == b"\1\0\0\0")
    deep = bam.Index.deep_enough(1 << 31)
    deep.add(0, (1 << 30) + 5, (1 << 30) + 50, True, 1 << 16, 2 << 16)
    back = bam.Index.load(deep.dump(1))
    assert deep.suffix == ".csi" and back.depth == 6 and back.places(0) == [(1 << 16, 2 << 16)] and back.places(0, 1 << 30, (1 << 30) + 9) == [(1 << 16, 2 << 16)] and back.places(0, 0, 9) == []


def test_bins():
    from readloom.sources.bai import bin_of, bins_of

    assert bin_of(0, 1) == 4681 and bin_of(0, 1 << 29) == 0 and bin_of((1 << 14) - 1, (1 << 14) + 1) == 585
    rng = random.Random(3)
    for _ in range(200):
        a, c = rng.randrange(1 << 20), rng.randrange(1 << 20)
        b, d = a + rng.randrange(1, 1 << 15), c + rng.randrange(1, 1 << 15)
        assert not (a < d and c < b) or bin_of(a, b) in bins_of(c, d)


def test_states_of_files(spark, file, tmp_path):
    path, records = file
    whole = written(spark, path, tmp_path, "ok.bam")
    data = bam.store.read(whole)
    header = bam.pack_blocks(bam.header_bytes("@HD\tVN:1.6\tSO:coordinate\n", [("c1", 5000)]))
    body = lambda rs: bam.pack_blocks(b"".join(len(r).to_bytes(4, "little") + r for r in rs))
    backwards = [bam.encode_record("x", 0, p, [(5, "M")], "", {}) for p in (9, 3)]
    cases = {
        "a-ok.bam": (data, "ok"), "b-empty.bam": (b"", "empty"), "c-text.bam": (b"hello, this is no alignment file", "no header"), "d-cut.bam": (data[:-28], "truncated"),
        "e-block.bam": (data[: len(data) // 2], "truncated"), "f-none.bam": (bam.pack_blocks(bam.header_bytes("", [])) + bam.END_BLOCK, "no references"),
        "g-norecords.bam": (header + bam.END_BLOCK, "no records"), "h-unsorted.bam": (header + body(backwards) + bam.END_BLOCK, "unsorted"),
        "i-other.bam": (path.read_bytes(), "other order"), "j-header.bam": (header[: len(header) // 2], "no header"),
    }
    folder = tmp_path / "states"
    folder.mkdir()
    for name, (content, _) in cases.items():
        (folder / name).write_bytes(content)
    for split in (1 << 25, 3000):
        got = dict(bam.check_input(spark, str(folder), split))
        assert {k.rsplit("/", 1)[1]: v for k, v in got.items()} == {k: v for k, (_, v) in cases.items()}
    with pytest.raises(bam.BamError):
        bam.build_index(spark, str(folder / "h-unsorted.bam"))


def test_encode(spark, tmp_path):
    from fixtures import aln, frame, refs

    bam.register(spark)
    rows = [aln("a", "x", 5, 45, nm=2, xo=1), aln("b", "y", 0, 30), aln("c", "x", 7, 50, score=None)]
    alns, references = frame(spark, rows), refs(spark, ("x", 100), ("y", 200))
    out = f"file://{tmp_path}/e"
    lengths = json.dumps([["x", 100], ["y", 200]])
    encoded = bam.encode_alignments(alns, references).orderBy("header_order", "reference_start")
    encoded.write.format("bam").mode("overwrite").option("lengths", lengths).option("order", "coordinate").option("layout", "files").save(out)
    back = spark.read.format("bam").load(out)
    pick = ["query_name", "reference", "reference_start", "reference_end", "is_reverse", "mapping_quality", "query_alignment_length", "nm", "as_score", "xo", "xg"]
    assert sorted(map(str, back.select(pick).collect())) == sorted(map(str, alns.select(pick).collect()))
    assert bam.read_references(spark, out).count() == 2
    assert {s for _, s in bam.check_input(spark, out)} <= {"ok", "no records"}


def test_long_headers_are_parsed_once(tmp_path, monkeypatch):
    """Not again for each of their blocks, nor for each file of a folder."""
    data = bam.header_bytes("@HD\tVN:1.6\n", [(f"reference{i}", 100) for i in range(2000)])
    (tmp_path / "lines").mkdir()
    for i in range(5):
        (tmp_path / "lines" / f"part-{i}.bam").write_bytes(bam.pack_blocks(data, 500) + bam.END_BLOCK)
    calls, parse = [], bam.parse_header
    monkeypatch.setattr(bam, "parse_header", lambda d: calls.append(len(d)) or parse(d))
    reader = bam.BamReader({"path": str(tmp_path / "lines")})
    assert reader.names[-1] == "reference1999" and len(reader.first) == 5
    assert len(calls) < 15


def test_columns_equal_single_records(file):
    """Batches of records against the functions for one: rows, extents, index, places."""
    import io

    import numpy as np
    import pyarrow as pa

    from readloom.sources import bai, batches

    path, records = file
    extra = b"XZZsome text\0" + b"XBBs\2\0\0\0\1\0\2\0" + b"NMC\7" + b"ASs\xfe\xff" + b"XAAx"
    full = [r + extra if i % 3 == 0 else r for i, r in enumerate(records)]
    data, ends = batches.with_sizes(pa.array(full, pa.binary()))
    sizes = np.diff(np.append(0, ends)) - 4
    starts = ends - sizes
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in bam.ALIGNMENT.split(", "))])
    rows = batches.columns(data, starts, sizes, pa.array(["c1", "c2"]), True, schema).to_pylist()
    assert [tuple(r.values()) for r in rows] == [bam.parse_record(r, ["c1", "c2"]) for r in full]
    where = batches.extents(data, starts)
    assert list(zip(*(x.tolist() for x in where), strict=True)) == [bam.extent(r) for r in full]
    one, many = bam.BlockWriter(io.BytesIO()), bam.BlockWriter(io.BytesIO())
    one.SIZE = many.SIZE = 900
    a, b = bai.Index(), bai.Index()
    for r in full:
        one.make_room(len(r) + 4)
        start = one.tell()
        one.write(len(r).to_bytes(4, "little") + r)
        a.add(*bam.extent(r), start, one.tell())
    for i in range(0, len(full), 70):
        base = ends[i - 1] if i else 0
        part = slice(i, i + 70)
        b.add_all(*(x[part] for x in where), *many.write_records(data[base : ends[part][-1]], ends[part] - base))
    one.flush(), many.flush()
    assert one.out.getvalue() == many.out.getvalue() and a.dump(2) == b.dump(2) and a.placeless == b.placeless


@pytest.mark.parametrize("level", [1, 6])
def test_plain_columns_are_encoded_by_the_writer(spark, tmp_path, level):
    rows = [(f"q{i}", ("b", "a", None)[i % 3], 7 * i if i % 3 < 2 else None, 30 + i, i % 2 == 0, i, i % 5, None if i % 4 else 9, 1, None) for i in range(90)]
    kinds = "query_name string, reference string, reference_start bigint, query_alignment_length int, is_reverse boolean, mapping_quality int, nm int, as_score int, xo int, xg int"
    alns = spark.createDataFrame(rows, kinds)
    references = spark.createDataFrame([("b", 0), ("a", 1)], "reference string, header_order int")
    bam.register(spark)
    held = []
    for name, form in (("plain", alns.orderBy(F.col("reference").desc_nulls_last(), "reference_start")), ("raw", bam.encode_alignments(alns, references, by_place=True).orderBy(F.col("header_order").asc_nulls_last(), "reference_start"))):
        path = str(tmp_path / name)
        form.coalesce(1).write.format("bam").mode("overwrite").option("lengths", json.dumps([["b", 9000], ["a", 9000]])).option("order", "coordinate").option("layout", "files").option("level", level).save(path)
        held.append((sorted(bytes(r.raw) for r in spark.read.format("bam").load(path).select("raw").collect()), sorted(map(tuple, bam.index_counts(spark, path).collect()))))
    assert held[0] == held[1] and len(held[0][0]) == 90
    # What an index counts selects the same records as counting them.
    read = spark.read.format("bam").option("raw", "false").load(path)
    for least in (1, 30, 31):
        a, b = (align.keep_frequent_references(read, least, c).select("query_name") for c in (None, bam.index_counts(spark, path)))
        assert sorted(a.collect()) == sorted(b.collect())


def test_statistics_count_by_the_index(spark, tmp_path, monkeypatch):
    """Where files have indexes, records are not read to count them."""
    kinds = "query_name string, reference string, reference_start bigint, query_alignment_length int, is_reverse boolean, mapping_quality int, nm int, as_score int, xo int, xg int"
    alns = spark.createDataFrame([(f"q{i}", "rs"[i % 10 == 0], 7 * i, 40, False, 30, 1, 9, 0, 0) for i in range(50)], kinds).orderBy("reference", "reference_start")
    bam.register(spark)
    path, table = str(tmp_path / "in"), str(tmp_path / "stats.tsv")
    alns.coalesce(1).write.format("bam").mode("overwrite").option("lengths", json.dumps([["r", 9000], ["s", 9000]])).option("order", "coordinate").option("layout", "files").save(path)

    def fail(alignments):
        raise AssertionError("records were counted")

    monkeypatch.setattr(align, "index_stats", fail)
    assert cli.main(["filter", "--bam", path, "--stats", table, "-n", "6", "--low-memory"]) == 0
    assert [line.split("\t")[0] for line in open(table)] == ["reference", "r"]
