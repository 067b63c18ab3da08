"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source is a queue of its documents in a seeded shuffle. A document's virtual finish time is the number of
source tokens up to its end, divided by the source's weight; a further pass over the source (at most ``max_repeats``)
continues the count. Sorting all finish times and cutting at the total budget serves the sources by weight; a source
that has no passes left stops, and what it would have got goes to the others in proportion to weight.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in the order of
sources; rows that repeat a doc_id are documents of their own, and wholly equal rows are taken one by one; an empty
table gives an empty result; input columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, buckets_for, free_prefix

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: int = 3, budget_share: float = 1.0) -> DataFrame:
    """One row per source: source, source_size, weight, target, budget.

    ``weights`` repeat over the sources in code-point order, null last. Targets share the budget by weight; one that
    would pass ``max_repeats`` times its source's size stops there, and the rest is shared again. Sources are a table
    of one row each, which one task can sort; that bounds their number to some millions.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    full = by_source.select("source", "source_size", weight.cast("double").alias("weight"), (F.sum("source_size").over(everything) * F.lit(budget_share)).alias("budget"))
    # Sources fill up in the order of capacity over weight. With those before a source full, the rest of the budget over
    # the weight still open is the level up to which the open ones are served; the first level not above a source's own
    # ratio holds for it and all later ones (levels only fall from there, so it is the greatest such level).
    capacity = F.col("source_size") * F.lit(float(max_repeats))
    fill = everything.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = full.withColumn("ratio", capacity / F.col("weight"))
    level = (F.col("budget") - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level)
    open_level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(capacity, F.coalesce(F.col("weight") * open_level, capacity))
    return leveled.select("source", "source_size", "weight", target.alias("target"), "budget")


def _queue(docs: DataFrame, weights: tuple[float, ...], max_repeats: int, budget_share: float, seed: int, texts: bool = True) -> tuple[DataFrame, str, tuple | None]:
    """All columns of docs and, under a prefix of their own, each document's place in its source's queue; that prefix;
    the first item (virtual finish time, shuffle key, pass) that the budget has no room for, or None.

    Without ``texts`` sizes and keys are made once and the texts stay where they are.

    No task holds a whole source: running counts are made within buckets of the shuffle order, and a second running
    count goes over the buckets' sums, of which there are about as many as rows in a bucket.
    """
    own = free_prefix(docs.columns)
    c = lambda name: F.col(f"{own}{name}")
    size = word_count(F.col("text"))
    shuffle = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    keyed = docs.select("*", size.alias(f"{own}size"), shuffle.alias(f"{own}h"), key.alias(f"{own}key"))
    columns = [x for x in docs.columns if texts or x != "text"]
    if not texts:
        keyed = Scratch.table(keyed.drop("text"), "mix-keyed")
    sizes = keyed.select(F.col("source"), c("size").alias("size"), c("key").alias("key"), c("h").alias("h"))
    if texts:
        sizes = Scratch.table(sizes, "mix-sizes")
    n = buckets_for(sizes.count())
    # Buckets are equal ranges of the shuffle key, so the queue's order is that of the key, whatever their number.
    bucket = lambda h: F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * n, 32)
    targets = Scratch.table(source_targets(sizes, weights, max_repeats, budget_share).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))), "mix-targets")
    targets = targets.drop("source")
    sums = sizes.groupBy("key", bucket(F.col("h")).alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("start"))
    known = starts.join(targets, "key").select(*[F.col(x).alias(f"{own}{x}") for x in ("key", "bucket", "start", "source_size", "weight", "target", "budget")])
    keyed = keyed.withColumn(f"{own}bucket", bucket(c("h")))
    within = Window.partitionBy(f"{own}key", f"{own}bucket").orderBy(f"{own}h").rowsBetween(Window.unboundedPreceding, 0)
    queued = keyed.withColumn(f"{own}run", F.sum(f"{own}size").over(within)).join(known, [f"{own}key", f"{own}bucket"])
    queued = queued.withColumn(f"{own}finish", c("start") + c("run"))
    queued = Scratch.table(queued.select(*[F.col(f"`{x}`") for x in columns], *[f"{own}{x}" for x in ("size", "h", "finish", "source_size", "weight", "target")]), "mix-queue")

    # One item for each pass: its virtual finish time, in one global order.
    items = queued.filter(c("size") > 0).select(c("h").alias("h"), c("size").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("pass"), c("finish").alias("finish"), c("source_size").alias("source_size"), c("weight").alias("weight"))
    items = items.select("h", "size", "pass", ((F.col("pass") * F.col("source_size") + F.col("finish")) / F.col("weight")).alias("vft"))
    top = targets.agg(F.max(F.col("target") / F.col("weight")), F.max("budget")).first()
    if not top[1]:
        return queued, own, (float("-inf"), "", 0)
    # Ranges of virtual time: a source is served at an even rate, so equal widths up to the level hold like loads.
    width = max(top[0], 1e-9) / n
    ranged = items.withColumn("range", F.least(F.floor(F.col("vft") / width), F.lit(2 * n)).cast("long"))
    loads = ranged.groupBy("range").agg(F.sum("size").alias("load"))
    # One row per range, about the square root of the rows of docs: a sort for one task.
    so_far = loads.select("range", "load", F.sum("load").over(Window.orderBy("range")).alias("upto"))
    cut = so_far.filter(F.col("upto") > top[1]).orderBy("range").select("range", (F.col("upto") - F.col("load")).alias("before")).first()
    if cut is None:
        return queued, own, None
    # Only the range that holds the cut is sorted item by item.
    order = Window.orderBy("vft", "h", "pass")
    edge = ranged.filter(F.col("range") == cut[0]).select("vft", "h", "pass", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    first_out = edge.filter(F.col("run") > top[1] - cut[1]).orderBy("vft", "h", "pass").first()
    return queued, own, tuple(first_out)[:3]


def _virtual(own: str, number: Column | int) -> Column:
    """Virtual finish time of a pass."""
    number = F.lit(number) if isinstance(number, int) else number
    return (number * F.col(f"{own}source_size") + F.col(f"{own}finish")) / F.col(f"{own}weight")


def _passes(own: str, cut: tuple | None, max_repeats: int) -> Column:
    """How many passes of a document come before the cut in the global order."""
    passes = F.lit(0)
    for k in range(max_repeats):
        item = F.struct(_virtual(own, k).alias("a"), F.col(f"{own}h").alias("b"), F.lit(k).alias("c"))
        before = F.lit(True) if cut is None else item < F.struct(F.lit(float(cut[0])).alias("a"), F.lit(cut[1]).alias("b"), F.lit(cut[2]).alias("c"))
        passes = passes + F.when(before, 1).otherwise(0)
    return F.when(F.col(f"{own}size") > 0, passes).otherwise(0).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: int = 3, budget_share: float = 1.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, finish_time (virtual, of the first pass), passes (times the document
    is taken), taken (tokens taken)."""
    queued, own, cut = _queue(docs.select("doc_id", "source", "text"), weights, max_repeats, budget_share, seed, texts=False)
    c = lambda name: F.col(f"{own}{name}")
    out = queued.withColumn(f"{own}passes", _passes(own, cut, max_repeats))
    return out.select("doc_id", c("size").alias("size"), "source", c("source_size").alias("source_size"), c("target").cast("double").alias("target"), _virtual(own, 0).alias("finish_time"), c("passes").alias("passes"), (c("passes") * c("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: int = 3, budget_share: float = 1.0, seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken, range-sorted into the global order of service."""
    queued, own, cut = _queue(docs, weights, max_repeats, budget_share, seed)
    taken = queued.withColumn(f"{own}passes", _passes(own, cut, max_repeats)).filter(F.col(f"{own}passes") > 0)
    served = taken.withColumn(f"{own}pass", F.explode(F.sequence(F.lit(0), F.col(f"{own}passes") - 1)))
    served = served.withColumn(f"{own}vft", _virtual(own, F.col(f"{own}pass")))
    return served.orderBy(f"{own}vft", f"{own}h", f"{own}pass").select(*[F.col(f"`{x}`") for x in docs.columns])
