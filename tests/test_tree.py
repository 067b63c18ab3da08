"""Ancestors by doubling and by number, against plain Python."""

import random

import pytest
from fixtures import aln, frame

from readloom.operators import lca
from readloom.operators.tree import CycleError, doubled, tree_index, walks


def test_rounds_and_walks(spark):
    edges = [(i, i // 2 if i > 1 else None) for i in range(1, 40)] + [(100 + i, 99 + i if i else 39) for i in range(26)]
    tables = doubled(spark.createDataFrame(edges, "node long, up long"))
    assert len(tables) == 5  # 125 has 31 ancestors
    up = dict(edges)
    got = {}
    for r in walks(spark.createDataFrame([(125,), (39,), (1,), (7,)], "start long"), tables).collect():
        got.setdefault(r.start, {})[r.depth] = r["at"]
    for start in (125, 39, 1, 7):
        way, x = [], start
        while x is not None:
            way.append(x)
            x = up[x]
        assert [got[start][d] for d in range(len(got[start]))] == way
    with pytest.raises(CycleError):
        doubled(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, up long"), most=16)
    assert doubled(spark.createDataFrame([(1, None)], "node long, up long")) == []


def brute(hits, paths):
    out = {}
    for read in {q for q, _ in hits}:
        own = sorted({tuple(paths[r]) for q, r in hits if q == read and r in paths})
        if own:
            shared = list(own[0])
            for p in own[1:]:
                shared = [x for i, x in enumerate(shared) if x in p and x not in shared[:i]]
            out[read] = (len(own), shared)
    return out


@pytest.mark.parametrize("tangled", [False, True])
def test_read_lca(spark, tangled):
    rng = random.Random(tangled)
    paths = {}
    for i in range(60):
        path, at = ["root"], ""
        for _ in range(rng.randrange(0, 9)):
            at += rng.choice("ab")
            path.append(at)
        if tangled and i % 5 == 0:
            path.insert(rng.randrange(1, len(path) + 1), "knot")
        paths[f"r{i}"] = [*path, f"r{i}"]
    hits = [(f"q{rng.randrange(50)}", f"r{rng.randrange(64)}") for _ in range(150)]
    table = spark.createDataFrame(list(paths.items()), "reference string, path array<string>")
    index = tree_index(table)
    assert index.tangled is tangled
    got = {r.read: (r.n_paths, r.path) for r in lca.read_lca(frame(spark, [aln(q, r, 0, 40) for q, r in hits]), table, index).collect()}
    assert got == brute(hits, paths)
    alns = frame(spark, [aln(q, r, 0, 40) for q, r in hits])
    want = lca.path_counts(lca.classify(lca.read_lca(alns, table, index), 1))
    key = lambda df: sorted((r.kind, tuple(r.path), r.reads) for r in df.collect())
    assert key(lca.lca_counts(alns, table, 1)) == key(want)


def test_no_path_is_exchanged_with_reads(spark):
    table = spark.createDataFrame([("a", ["root", "x", "a"]), ("b", ["root", "x", "b"]), ("c", ["root", "c"])], "reference string, path array<string>")
    x = lca.read_nodes(frame(spark, [aln("q", "a", 0, 40), aln("q", "b", 0, 40)]), tree_index(table))
    plan = x._jdf.queryExecution().toString()
    assert "path" not in plan.split("== Physical Plan ==")[1].replace("paths", "").replace("Path", "").replace("n_paths", "").replace("(1 path", "")
    assert "collect" not in plan


def test_nothing(spark):
    empty = spark.createDataFrame([], "reference string, path array<string>")
    assert lca.read_lca(frame(spark, [aln("q", "a", 0, 40)]), empty).count() == 0
