import pytest
from pyspark.sql import functions as F
from fixtures import aln, frame, refs

from readloom.config import ConfigError, LcaConfig
from readloom.operators import lca
from readloom.plans import pipelines

NODES = "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tphylum\t|\n3\t|\t2\t|\tgenus\t|\n4\t|\t3\t|\tspecies\t|\n5\t|\t3\t|\tspecies\t|\n6\t|\t2\t|\tgenus\t|\n7\t|\t6\t|\tspecies\t|\n8\t|\t1\t|\tphylum\t|\n"
NAMES = "".join(f"{i}\t|\t{n}\t|\t\t|\tscientific name\t|\n{i}\t|\talias{i}\t|\t\t|\tsynonym\t|\n" for i, n in enumerate(["root", "P", "G", "Sa", "Sb", "H", "Sc", "Q"], 1))


@pytest.fixture(scope="module")
def dumps(spark, tmp_path_factory):
    from readloom.sources import taxonomy

    d = tmp_path_factory.mktemp("tax")
    (d / "nodes.dmp").write_text(NODES)
    (d / "names.dmp").write_text(NAMES)
    (d / "acc.tsv").write_text("accession\taccession.version\ttaxid\tgi\na\ta\t4\t0\nb\tb\t5\t0\nc\tc\t7\t0\nd\td\t8\t0\n")
    return taxonomy.read_accessions(spark, str(d / "acc.tsv")), taxonomy.read_nodes(spark, str(d / "nodes.dmp")), taxonomy.read_names(spark, str(d / "names.dmp"))


def reads(spark, **hits):
    return frame(spark, [aln(q, r, 0, 40) for q, refs_ in hits.items() for r in refs_])


def run(spark, dumps, alns, rank="genus", **kw):
    references = refs(spark, ("a", 1000), ("b", 500), ("c", 250), ("d", 100), ("zz", 100)).drop("reference_length")
    out = pipelines.lca_summary(alns, references, *dumps, LcaConfig(rank=rank, **{k: v for k, v in kw.items() if k == "custom"}), stats=kw.get("stats"))
    return {r["name"]: (r.taxid, r["rank"], r.n_reads, r.abundance, r.tax_path) for r in out.collect()}


def test_unique_and_shared_reads(spark, dumps):
    alns = reads(spark, q1=["a"], q2=["a"], q3=["b"], q4=["a", "b"], q5=["a", "c"], q6=["zz"], q7=["d"])
    got = run(spark, dumps, alns)
    # q4's LCA is G: its weight lies on the edge into G, so only P and root gain. q5's LCA (P) is above the rank.
    assert got["Sa"] == (4, "species", 2, 2000, "root;P;G;Sa") and got["Sb"][2:4] == (1, 2000)
    assert got["G"][2:4] == (3, 4000)
    # the likeliest reference below G is a: (3 gathered at G) * (2 at Sa) * (2 on the leaf's edge + ...), its length 1000
    assert got["P"][2:4] == (4, 5000) and got["root"][2:4] == (4, 5000)
    assert set(got) == {"root", "P", "G", "Sa", "Sb"}


def test_rank_boundary(spark, dumps):
    alns = reads(spark, q1=["a"], q4=["a", "b"])
    assert run(spark, dumps, alns, rank="genus")["P"][2] == 2
    assert run(spark, dumps, alns, rank="species")["P"][2] == 1
    with pytest.raises(ConfigError):
        run(spark, dumps, alns, rank="tribe")


def test_no_continuation_counts_raw(spark, dumps):
    got = run(spark, dumps, reads(spark, q1=["c"], q4=["a", "b"]))
    assert got["P"][2:4] == (2, 4001)


def test_template_drops_incomplete_references(spark, dumps):
    assert "Q" not in run(spark, dumps, reads(spark, q1=["a"], q7=["d"]))


def test_stats_window(spark, dumps):
    alns = reads(spark, **{f"q{i}": ["a"] for i in range(5)}, **{f"p{i}": ["b"] for i in range(3)}, **{f"o{i}": ["c"] for i in range(2)})
    stats = spark.createDataFrame([("a", 5, 3, 100.0), ("b", 2, 1, 100.0), ("c", 9, 2, 100.0)], "reference string, n_reads bigint, n_reads_tad bigint, coverage_mean_trunc_len double")
    got = run(spark, dumps, alns, stats=stats)
    # a: in the window; b: more reads than n_reads; c: not more than n_reads_tad
    assert got["Sa"][2:4] == (3, 30000) and "Sb" not in got and "Sc" not in got


def test_custom_subspecies_comes_after_root(spark, dumps):
    accessions, nodes, names = dumps
    got = run(spark, (accessions, nodes, names), reads(spark, q1=["a"]), custom=True)
    assert got["root"][2] == 1 and got["S__a"][4] == "root;S__a"


def test_no_reads(spark, dumps):
    assert run(spark, dumps, frame(spark, [])) == {}


def test_name_collision_merges_by_name(spark):
    paths = spark.createDataFrame([("a", ["root", "X", "a"]), ("b", ["root", "Y", "X", "b"])], "reference string, path array<string>")
    alns = reads(spark, q1=["a"], q2=["b"])
    counts = lca.path_counts(lca.classify(lca.read_lca(alns, paths), 0))
    weights = lca.unique_weights(counts, refs(spark, ("a", 10), ("b", 10)), 10)
    got = {r.node: r.n_reads for r in lca.roll_up(weights).collect()}
    assert got == {"root": 2, "X": 2, "Y": 1}


def _taxonomy(spark, rows):
    nodes = spark.createDataFrame([(i, p, r) for i, p, r, _ in rows], "taxid long, parent long, rank string")
    return nodes, spark.createDataFrame([(i, n) for i, _, _, n in rows], "taxid long, name string")


def test_repeated_ranks_and_deep_lineages(spark):
    from readloom.sources import taxonomy

    chain = [(1, 1, "no rank", "root"), (2, 1, "superkingdom", "K"), (3, 2, "clade", "C1"), (4, 3, "clade", "C2"), (5, 4, "genus", "G"), (6, 5, "clade", "C3")]
    chain += [(i, i - 1, "no rank" if i % 7 else f"rank{i}", f"n{i}") for i in range(7, 107)]
    nodes, names = _taxonomy(spark, chain)
    found = taxonomy.lineages(spark.createDataFrame([(6,), (5,), (106,), (1,)], "taxid long"), nodes, names)
    got = {r.taxid: [tuple(e) for e in r.e] for r in found.select("taxid", F.map_entries("lineage").alias("e")).collect()}
    # a repeated rank stands at its lowest place with its highest name
    assert got[6] == [("clade", "C1"), ("genus", "G"), ("superkingdom", "K")]
    assert got[5] == [("genus", "G"), ("clade", "C1"), ("superkingdom", "K")]
    assert got[106][0] == ("rank105", "n105") and got[106][-1] == ("superkingdom", "K") and len(got[106]) == 3 + 15
    assert 1 not in got
    ring = spark.createDataFrame([(1, 2, "genus"), (2, 1, "family")], "taxid long, parent long, rank string")
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.lineages(spark.createDataFrame([(1,)], "taxid long"), ring, spark.createDataFrame([(1, "a"), (2, "b")], "taxid long, name string"), most=16)


def test_custom_subspecies_keeps_its_place(spark):
    from readloom.sources import taxonomy

    nodes, names = _taxonomy(spark, [(1, 1, "no rank", "root"), (2, 1, "genus", "G"), (3, 2, "species", "S"), (4, 3, "subspecies", "T")])
    references = spark.createDataFrame([("a", 0), ("b", 1)], "reference string, header_order int")
    accessions = spark.createDataFrame([("a", 4), ("b", 3)], "reference string, taxid long")
    found = taxonomy.reference_lineages(references, accessions, nodes, names, custom=True)
    assert taxonomy.rank_template(found) == ["genus", "species", "subspecies"]
    got = {r.reference: [tuple(e) for e in r.e] for r in found.select("reference", F.map_entries("lineage").alias("e")).collect()}
    assert got["a"] == [("subspecies", "S__a"), ("species", "S"), ("genus", "G")]
    assert got["b"] == [("species", "S"), ("genus", "G"), ("subspecies", "S__b")]
