"""Named files from parts, empty outputs, states of the input on the command line."""

import gzip

import pytest
from fixtures import aln, frame, refs
from pyspark.sql import functions as F

from readloom import cli
from readloom.config import FilterConfig
from readloom.plans import pipelines
from readloom.sources import bam, sinks


@pytest.mark.parametrize("name", ["t.tsv", "t.tsv.gz"])
def test_one_sorted_file_from_many_parts(spark, tmp_path, name):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), F.concat(F.lit("x"), "id").alias("v")).repartition(7)
    path = f"file://{tmp_path}/{name}"
    for _ in range(2):  # an earlier file is replaced
        sinks.write_tsv(df, path, ("n",))
    raw = (tmp_path / name).read_bytes()
    lines = (gzip.decompress(raw) if name.endswith("gz") else raw).decode().splitlines()
    assert lines[0] == "n\tv" and [int(x.split("\t")[0]) for x in lines[1:]] == list(range(5000))
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == [name]
    assert spark.read.option("header", True).option("sep", "\t").csv(path).count() == 5000


def test_nothing_in_a_table(spark, tmp_path):
    none = spark.range(3).filter("id > 5")
    sinks.write_tsv(none, f"{tmp_path}/a.tsv")
    sinks.write_tsv(none, f"{tmp_path}/b.tsv.gz", blank=True)
    assert (tmp_path / "a.tsv").read_text() == "id\n" and (tmp_path / "b.tsv.gz").read_bytes() == b""
    sinks.write_tsv(spark.range(3), f"{tmp_path}/c", one_file=False)
    assert (tmp_path / "c").is_dir() and spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 3


def test_inputs_without_records_and_broken_ones(spark, tmp_path):
    header = bam.pack_blocks(bam.header_bytes("@HD\tVN:1.6\tSO:coordinate\n", [("c1", 500)]))
    (tmp_path / "none.bam").write_bytes(header + bam.END_BLOCK)
    (tmp_path / "cut.bam").write_bytes(header)
    (tmp_path / "kept.tsv").write_text("as it was")
    run = lambda *a: cli.main([*a])
    assert run("filter", "--bam", f"{tmp_path}/none.bam", "-p", f"{tmp_path}/o", "--stats", f"{tmp_path}/kept.tsv", "--stats-filtered", "--bam-filtered", "--read-hits-count") == 0
    assert (tmp_path / "kept.tsv").read_text() == "as it was" and (tmp_path / "o_stats-filtered.tsv.gz").read_bytes() == b"" and (tmp_path / "o_read-hits-count.tsv.gz").exists()
    text, references, _ = bam.read_header(f"{tmp_path}/o.filtered.bam")
    assert text.split() == ["@HD", "VN:1.0", "SO:unsorted"] and references == []
    assert run("reassign", "--bam", f"{tmp_path}/none.bam", "-o", f"{tmp_path}/r.bam") == 0 and bam.read_header(f"{tmp_path}/r.bam")[1] == []
    assert run("filter", "--bam", f"{tmp_path}/cut.bam", "--stats", f"{tmp_path}/never.tsv") == 1 and not (tmp_path / "never.tsv").exists()


def test_stored_records_give_the_same_and_are_exchanged_once(spark):
    rows = [aln(f"q{i % 50}", f"r{i % 3}", i % 400, i % 400 + 40 + i % 7, nm=i % 3) for i in range(300)] + [aln("z", "few", 0, 40)]
    alns, references = frame(spark, rows), refs(spark, *[(f"r{i}", 500) for i in range(3)], ("few", 100)).drop("reference_length")
    config = FilterConfig(read_hits_count=True)
    plain, stored = (pipelines.filter_references(alns, references, config, stored=s) for s in (False, True))
    key = lambda df: sorted(map(str, df.collect()))
    for name in ("stats", "passing", "alignments", "read_hits"):
        assert key(getattr(plain, name)) == key(getattr(stored, name))
    plan = stored.alignments._jdf.queryExecution().executedPlan().toString()
    assert "query_sequence" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "query_sequence" in line]
