"""N-gram Jaccard join by a MinHash LSH forest.

A document is the set of its word 5-grams (of all its words, if it has fewer). Its signature of ``trees`` times
``depth`` MinHash values gives it one label in each of ``trees`` prefix tries.

* All labels are sorted by trie and label (range partitions, whatever the size of a group); a label's longest matched
  prefix is the one it shares with its neighbour in that order.
* Matching starts at full labels. The matched prefix is shortened, level by level, until two things hold: a pair at
  the threshold is found in some trie with probability ``guarantee``, and of the pairs that the neighbours show, at the
  similarities that their signatures show, the part found by that level is at least ``recall``.
* Labels that share the prefix of that level are a node. Each member of a node is compared by signature with the
  node's least member, and those unlike it with all members, in blocks. Only pairs whose signatures leave the threshold
  possible chain into clusters, so chance meetings in a node don't.
* Inside a cluster pairs are verified exactly, in blocks bounded by members and by n-grams. Blocks are cut along the
  sizes of the sets; two blocks meet only if sets of their sizes can reach the threshold. Tasks return counts and a
  spanning forest, never the pairs.

Documents with equal sets count as copies: one of them stands for all.

Defined cases: documents without words (null, empty, white space) and rows without doc_id are alike to nothing; very
long texts are shingled whole; rows that repeat a doc_id count as one document, which may have several sets; an empty
table gives an empty result; input columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import U, mix64, shingle_hashes, word_hashes
from .runtime import Scratch, free_prefix, prepare

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
#: Of the pairs at hand, and of a pair right at the threshold.
RECALL = 0.998
GUARANTEE = 0.99
#: Labels that share a shorter prefix with both neighbours are left out where no target can ask for it (``least_level``).
LEAST = 2
#: Standard deviations by which the signatures of a pair at the threshold may fall short.
SLACK = 4.5
#: Members and n-grams of a block of sets that are compared with one another in one task; members by signature only.
SETS = 512
GRAMS = 1_500_000
SIGNATURES = 4096
#: Small tables of ids are broadcast up to this number of rows, and shuffled beyond.
BROADCAST_ROWS = 1_000_000


def found_at(similarity: np.ndarray | float, level: int, trees: int = TREES) -> np.ndarray | float:
    """Probability that a pair shares a prefix of this length in at least one trie."""
    return 1 - (1 - similarity**level) ** trees


def matched_level(agreements: dict[int, int], trees: int, depth: int, threshold: float, recall: float, guarantee: float) -> int:
    """The longest prefix that meets both targets. agreements: of trees * depth values, how many pairs agree in so many."""
    total = trees * depth
    similar = {a / total: n for a, n in agreements.items() if a / total >= threshold}
    pairs = sum(similar.values())
    level = depth
    while level > 1:
        expected = sum(n * found_at(s, level, trees) for s, n in similar.items())
        if found_at(threshold, level, trees) >= guarantee and expected >= recall * pairs:
            break
        level -= 1
    return level


def least_level(trees: int, threshold: float, recall: float, guarantee: float) -> int:
    """The shortest prefix that ``matched_level`` can answer: labels that share less are not kept."""
    target = max(recall, guarantee)
    if found_at(threshold, 1, trees) < guarantee:
        raise ValueError(f"{trees} trees find a pair at {threshold} with less than {guarantee}")
    return LEAST if found_at(threshold, LEAST, trees) >= target else 1


def plausible(trees: int, depth: int, threshold: float) -> int:
    """Values in which two signatures must agree for the pair to stay a candidate."""
    n = trees * depth
    return max(1, int(n * threshold - SLACK * (n * threshold * (1 - threshold)) ** 0.5))


def signature(shingles: np.ndarray, values: int, seed: int = 1) -> np.ndarray:
    """MinHash values, cut to 16 bits (big-endian, so labels sort as bytes)."""
    a = mix64(np.arange(seed, seed + values, dtype=U)) | U(1)
    b = mix64(np.arange(seed + values, seed + 2 * values, dtype=U))
    out = np.full(values, U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 512):
        h = shingles[None, at : at + 512] * a[:, None]
        h += b[:, None]
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        np.minimum(out, h.min(1), out=out)
    return mix64(out).astype(">u2")


def digest(shingles: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)
    return int(d[0]), int(d[1])


def signatures(docs: DataFrame, shingle: int, values: int) -> DataFrame:
    """doc_id, d1, d2 (128-bit digest of the set), n (its size) and sig (two bytes for each MinHash value)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_hashes(word_hashes(text), shingle)
                if len(s):
                    rows.append((doc_id, *digest(s), len(s), signature(s, values).tobytes()))
            yield _batch(rows, [("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null and text is not null")
    return ready.mapInArrow(run, "doc_id bigint, d1 bigint, d2 bigint, n bigint, sig binary")


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


LEAF = [("id", pa.int64()), ("tree", pa.int32()), ("label", pa.binary()), ("matched", pa.int32()), ("other", pa.int64()), ("edge", pa.int32())]


def _leaves(batches: Iterator[pa.RecordBatch], depth: int, least: int) -> Iterator[pa.RecordBatch]:
    """Longest prefix that each label shares with one of its neighbours; batches come sorted by tree and label.

    Kept are labels with a match and the first (edge 1) and last one (edge 2, or 3 if it is the first too).
    """
    ids, trees, labels = np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, depth), ">u2")
    before, before_id, first = 0, None, 1
    rows: list[tuple] = []

    def emit(upto: int, shared: np.ndarray) -> None:
        nonlocal before, before_id, first
        for i in range(upto):
            after = int(shared[i]) if i < len(shared) else 0
            last = 2 if i == len(ids) - 1 else 0
            if max(before, after) >= least or first or last:
                other = before_id if before >= after else int(ids[i + 1])
                rows.append((int(ids[i]), int(trees[i]), labels[i].tobytes(), max(before, after), other, first | last))
            before, before_id, first = after, int(ids[i]), 0

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.concatenate([ids, batch.column(0).to_numpy()])
        trees = np.concatenate([trees, batch.column(1).to_numpy()])
        new = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").reshape(-1, depth)
        labels = np.concatenate([labels, new])
        same = (labels[1:] == labels[:-1]) & (trees[1:] == trees[:-1])[:, None]
        emit(len(ids) - 1, np.cumprod(same, axis=1).sum(1))
        ids, trees, labels = ids[-1:], trees[-1:], labels[-1:]
        yield _batch(rows, LEAF)
        rows.clear()
    emit(len(ids), np.empty(0, np.int64))
    yield _batch(rows, LEAF)


def trie_leaves(sets: DataFrame, trees: int, depth: int, least: int = LEAST) -> DataFrame:
    """id, tree, label, matched (longest prefix shared with a neighbour) and other (that neighbour), matches of ``least`` only."""
    spark = sets.sparkSession
    each = sets.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "sig")
    labels = each.select("id", "tree", F.expr(f"substring(sig, tree * {2 * depth} + 1, {2 * depth})").alias("label"))
    ordered = labels.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    leaves = Scratch.table(ordered.mapInArrow(lambda b: _leaves(b, depth, least), "id bigint, tree int, label binary, matched int, other bigint, edge int"), "forest-leaves")
    # Where one partition ends and the next begins: two rows of each partition, whatever the number of labels.
    ends = sorted(((r.tree, bytes(r.label), r.id, r.matched, r.other) for r in leaves.filter("edge > 0").collect()), key=lambda r: r[:3])
    fixed = [list(r) for r in ends]
    for i in range(len(ends) - 1):
        (t1, l1, i1), (t2, l2, i2) = ends[i][:3], ends[i + 1][:3]
        shared = 0
        while t1 == t2 and shared < depth and l1[: 2 * shared + 2] == l2[: 2 * shared + 2]:
            shared += 1
        for at, other in ((i, i2), (i + 1, i1)):
            if shared > fixed[at][3]:
                fixed[at][3:] = [shared, other]
    inner = leaves.filter("edge = 0").drop("edge")
    if not fixed:
        return inner
    outer = spark.createDataFrame([(r[2], r[0], bytearray(r[1]), r[3], r[4]) for r in fixed], "id bigint, tree int, label binary, matched int, other bigint")
    return inner.unionByName(outer.filter(F.col("matched") >= least))


def _agreements(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) with the number of signature values in which they agree."""
    one, two = sets.select(F.col("id").alias("u"), F.col("sig").alias("s")), sets.select(F.col("id").alias("v"), F.col("sig").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(n, -1) if n else np.empty((0, 1)) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((s == t).sum(1), pa.int32())], ["u", "v", "agree"])

    return pairs.join(one, "u").join(two, "v").select("u", "v", "s", "t").mapInArrow(run, "u bigint, v bigint, agree int")


def _roots(link: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the least name in its component."""
    label = names.copy()
    while True:
        new = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            return label
        label = new


def _bipartite(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(member, least name of its component) for the linked members of a matrix of links between two sides."""
    a, b, top = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        b2 = np.minimum(b, np.where(link, a[:, None], top).min(0))
        a2 = np.minimum(a, np.where(link, b2[None, :], top).min(1))
        if (a2 == a).all() and (b2 == b).all():
            rows, cols = link.any(1), link.any(0)
            return [*zip(left[rows].tolist(), a[rows].tolist(), strict=True), *zip(right[cols].tolist(), b[cols].tolist(), strict=True)]
        a, b = a2, b2


def _unlike(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Links between the two sides of each task (node, one, two), by signature. Rows come sorted by task."""
    task, sides = None, {0: ([], []), 1: ([], [])}
    out: list[tuple[int, int]] = []

    def close() -> None:
        if sides[0][0] and sides[1][0]:
            (left, ls), (right, rs) = ((np.array(i, np.int64), np.frombuffer(b"".join(s), ">u2").reshape(len(i), -1)) for i, s in sides.values())
            link = np.zeros((len(left), len(right)), bool)
            for i in range(len(left)):
                link[i] = (rs == ls[i]).sum(1) >= least
            link &= left[:, None] != right[None, :]
            if link.any():
                out.extend(_bipartite(link, left, right))
        for i, s in sides.values():
            i.clear()
            s.clear()

    for batch in batches:
        x = batch.to_pydict()
        for key, side, i, sig in zip(zip(x["node"], x["one"], x["two"], strict=True), x["side"], x["id"], x["sig"], strict=True):
            if key != task:
                close()
                task = key
            sides[side][0].append(i)
            sides[side][1].append(sig)
        if len(out) > 5000:
            yield _batch(out, [("u", pa.int64()), ("v", pa.int64())])
            out.clear()
    close()
    yield _batch(out, [("u", pa.int64()), ("v", pa.int64())])


def candidate_edges(leaves: DataFrame, sets: DataFrame, level: int, least: int) -> DataFrame:
    """u, v: edges that connect whatever pairs share a node of this level and agree in at least ``least`` values."""
    node = F.xxhash64("tree", F.expr(f"substring(label, 1, {2 * level})"))
    members = Scratch.table(leaves.filter(F.col("matched") >= level).select(node.alias("node"), "id").distinct(), "forest-nodes")
    leaders = members.groupBy("node").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size"))
    led = members.join(leaders, "node").filter("id <> leader")
    pairs = Scratch.table(_agreements(led.select(F.col("id").alias("u"), F.col("leader").alias("v")).distinct(), sets), "forest-leads")
    edges = pairs.filter(F.col("agree") >= least).select("u", "v")
    # Members unlike their node's leader meet all members, but for the leader alone.
    apart = led.filter("size > 2").join(pairs.filter(F.col("agree") < least).select(F.col("u").alias("id"), F.col("v").alias("leader")), ["id", "leader"], "left_semi")
    apart = Scratch.table(apart.select("node", "id", "size"), "forest-apart")
    counts = apart.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SIGNATURES).cast("int").alias("lefts"), F.ceil(F.first("size") / SIGNATURES).cast("int").alias("rights"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = apart.select("node", "id").join(counts, "node").select("node", deal("lefts").alias("one"), spread("rights").alias("two"), F.lit(0).alias("side"), "id")
    right = members.join(counts, "node").select("node", spread("lefts").alias("one"), deal("rights").alias("two"), F.lit(1).alias("side"), "id")
    sided = left.unionByName(right).join(sets.select("id", "sig"), "id").select("node", "one", "two", "side", "id", "sig")
    more = sided.repartition("node", "one", "two").sortWithinPartitions("node", "one", "two").mapInArrow(lambda b: _unlike(b, least), "u bigint, v bigint")
    return Scratch.table(edges.unionByName(more), "forest-edges")


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray], wide: int = 8192) -> np.ndarray:
    """Sizes of the intersections of sorted distinct arrays, as a matrix of rows against cols."""
    same = rows is cols
    sides = [rows] if same else [rows, cols]
    owner = np.concatenate([np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in sides])
    side = np.repeat(np.arange(len(sides)), [sum(len(x) for x in s) for s in sides])
    _, column, often = np.unique(np.concatenate([x for s in sides for x in s]), return_inverse=True, return_counts=True)
    shared = often > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, side, column = owner[use], side[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, side, column = owner[order], side[order], column[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    n_columns = int(shared.sum())
    for at in range(0, n_columns, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        x = [np.zeros((len(s), min(wide, n_columns - at)), np.float32) for s in sides]
        for k, m in enumerate(x):
            mine = side[lo:hi] == k
            m[owner[lo:hi][mine], column[lo:hi][mine] - at] = 1
        out += x[0] @ x[-1].T
    return out.astype(np.int64)


def verify(ids: list[int], copies: list[int], sides: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int, int, int]]:
    """(id, least id linked in this task, linked documents, linked sets) of each member with a link.

    sides: 0 for all pairs; 1 and 2 if only pairs from different sides count.
    """
    side = np.array(sides)
    one = np.flatnonzero(side < 2)
    two = one if not side.any() else np.flatnonzero(side == 2)
    if not len(one) or not len(two):
        return []
    rows = [sets[i] for i in one]
    cols = rows if two is one else [sets[i] for i in two]
    key, weight = np.array(ids, np.int64), np.array(copies, np.int64)
    size = np.array([len(s) for s in sets])
    shared = overlaps(rows, cols)
    link = shared >= threshold * (size[one][:, None] + size[two][None, :] - shared) - 1e-9
    link &= key[one][:, None] != key[two][None, :]
    if two is one:
        root = _roots(link, key)
        return [(ids[i], int(root[i]), int(w), int(c)) for i, w, c in zip(range(len(ids)), link @ weight, link.sum(1), strict=True) if c]
    root: dict[int, int] = {}
    for i, r in _bipartite(link, key[one], key[two]):
        root[i] = min(r, root.get(i, r))
    out = [(ids[i], w, c) for i, w, c in zip(one, link @ weight[two], link.sum(1), strict=True) if c]
    out += [(ids[i], w, c) for i, w, c in zip(two, link.T @ weight[one], link.sum(0), strict=True) if c]
    return [(i, root[i], int(w), int(c)) for i, w, c in out]


def _verified(batches: Iterator[pa.RecordBatch], shingle: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task: one task's members are in memory at a time."""
    task, members, out = None, {}, []
    fields = [(c, pa.int64()) for c in ("id", "root", "links", "set_links")]

    def close() -> None:
        if len(members) > 1:
            ids, copies, sides, sets = zip(*((k[0], *m) for k, m in members.items()), strict=True)
            out.extend(verify(list(ids), list(copies), list(sides), list(sets), threshold))
        members.clear()

    for batch in batches:
        x = batch.to_pydict()
        for cluster, one, two, doc_id, d1, d2, copies, side, text in zip(*(x[c] for c in ("cluster", "one", "two", "id", "d1", "d2", "copies", "side", "text")), strict=True):
            if (cluster, one, two) != task:
                close()
                task = (cluster, one, two)
            # Rows that repeat a doc_id: each of its sets counts once.
            if (doc_id, d1, d2) not in members:
                s = shingle_hashes(word_hashes(text), shingle)
                if digest(s) == (d1, d2):
                    members[doc_id, d1, d2] = (copies, side, s)
        if len(out) > 5000:
            yield _batch(out, fields)
            out.clear()
    close()
    yield _batch(out, fields)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def block_tasks(mass: DataFrame, threshold: float) -> DataFrame:
    """mass (cluster, id, n and more) with tasks: the pairs of blocks (one, two) that a member takes part in, and its side.

    The members of a cluster are laid out by size of set, those of one size in any order, and cut into blocks. Only
    numbers by cluster and size are ordered, never the members of a cluster.
    """
    weight = F.greatest(F.lit(max(1, GRAMS // SETS)), "n")
    sizes = mass.groupBy("cluster", "n").agg(F.count(F.lit(1)).alias("often")).withColumn("weight", weight)
    up = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum(F.col("often") * F.col("weight")).over(up), F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("id"), F.col("often")) * F.col("weight")
    dealt = mass.join(sizes, ["cluster", "n"]).withColumn("block", F.floor(place / GRAMS)).drop("often", "weight", "before")
    dealt = Scratch.table(dealt, "forest-dealt")
    blocks = dealt.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = blocks.alias("a"), blocks.alias("b")
    meet = (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.block") <= F.col("b.block")) & (F.col("b.low") * threshold <= F.col("a.high") + 1e-6)
    pairs = a.join(b, meet).select("a.cluster", F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    part = lambda block, side: F.struct(F.col(block).alias("block"), F.col("one"), F.col("two"), F.lit(side).alias("side"))
    parts = F.when(F.col("one") == F.col("two"), F.array(part("one", 0))).otherwise(F.array(part("one", 1), part("two", 2)))
    tasks = pairs.select("cluster", F.inline(parts)).groupBy("cluster", "block").agg(F.collect_list(F.struct("one", "two", "side")).alias("tasks"))
    return dealt.join(tasks, ["cluster", "block"]).drop("block")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, guarantee: float = GUARANTEE
) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (documents at the threshold or above, copies included) and
    n_set_links (different n-gram sets among them), one row for each document with words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = Scratch.table(signatures(docs, shingle, trees * depth), "forest-signatures")
    # Of documents with equal sets one stands for all.
    sets = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.countDistinct("doc_id").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = Scratch.table(sets, "forest-sets")
    leaves = trie_leaves(sets, trees, depth, least_level(trees, threshold, recall, guarantee))
    seen = leaves.filter("id <> other").select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()
    agreements = {r[0]: r[1] for r in _agreements(seen, sets).groupBy("agree").count().collect()}
    level = matched_level(agreements, trees, depth, threshold, recall, guarantee)
    edges = candidate_edges(leaves, sets, level, plausible(trees, depth, threshold))
    clusters = components(edges)
    mass = clusters.join(sets.select(F.col("id").alias("node"), "d1", "d2", "copies", "n"), "node")
    mass = mass.select(F.col("component").alias("cluster"), F.col("node").alias("id"), "d1", "d2", "copies", "n")
    members = Scratch.table(block_tasks(mass, threshold), "forest-members")
    texts = docs.join(_small(members), docs["doc_id"] == members["id"]).select("cluster", "id", "d1", "d2", "copies", "tasks", F.col("text").cast("binary").alias("text")).filter("text is not null")
    # Each pair of blocks that meet is one task.
    tasks = texts.select("cluster", F.inline("tasks"), "id", "d1", "d2", "copies", "text")
    verified = tasks.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two", "id").mapInArrow(lambda b: _verified(b, shingle, threshold), "id bigint, root bigint, links bigint, set_links bigint")
    verified = Scratch.table(verified, "forest-links")
    classes = components(verified.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "id")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"), F.sum("set_links").alias("set_links"))
    # A document whose rows hold several texts lies in several sets; its least class counts.
    known = sets.select("d1", "d2", "id", "copies").join(classes, "id", "left").join(links, "id", "left")
    known = known.select("d1", "d2", F.coalesce("component", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("set_links", F.lit(0)).alias("n_set_links"))
    out = signed.select("doc_id", "d1", "d2").join(known, ["d1", "d2"])
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.max("n_set_links").alias("n_set_links"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the first document (least doc_id) of each class."""
    own = f"{free_prefix(docs.columns)}id"
    gone = near_duplicates(docs, **options).filter("class_id < doc_id").select(F.col("doc_id").alias(own))
    gone = Scratch.table(gone, "forest-gone")
    return docs.join(_small(gone), F.col("doc_id").cast("long") == F.col(own), "left_anti")
