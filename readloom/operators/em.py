"""Reads that map to several references are assigned by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, Window, WindowSpec
from pyspark.sql import functions as F

from ..iteration import Iteration

#: Tables of one row per reference are broadcast up to this number of rows.
BROADCAST_ROWS = 1_000_000


def _by_query() -> WindowSpec:
    return Window.partitionBy("query")


def initial(scores: DataFrame, lengths: DataFrame) -> DataFrame:
    """query, reference, slen, prob (scores scaled to 1 per query), iter, n_aln. lengths: reference, reference_length."""
    sized = scores.join(lengths.select("reference", F.col("reference_length").cast("double").alias("slen")), "reference")
    return sized.select("query", "reference", "slen", (F.col("score") / F.sum("score").over(_by_query())).alias("prob"), F.lit(0).alias("iter"), F.count(F.lit(1)).over(_by_query()).alias("n_aln"))


def step(state: DataFrame) -> DataFrame:
    """One pass without removal: probabilities weighed by their reference's weight per base, scaled to 1 per query.

    The weights are an aggregate that is joined back, so a reference with most of the alignments is no single task.
    """
    weights = state.groupBy("reference").agg((F.sum("prob") / F.first("slen")).alias("weight"))
    weighed = state.join(weights, "reference").withColumn("new", F.col("prob") * F.col("weight"))
    return weighed.select("query", "reference", "slen", (F.col("new") / F.sum("new").over(_by_query())).alias("prob"), "iter", F.count(F.lit(1)).over(_by_query()).alias("n_aln"))


def with_verdict(state: DataFrame, scale: float, number: int | Column) -> DataFrame:
    """stays: whether the alignment is its query's only one or near enough to the most probable."""
    near = F.col("prob") >= F.max("prob").over(_by_query()) * scale
    stays = (F.col("n_aln") == 1) | near
    return state.withColumn("stays", stays).withColumn("iter", F.when((F.col("n_aln") > 1) & near, number).otherwise(F.col("iter")))


def unroll(state: DataFrame, passes: int, scale: float) -> DataFrame:
    """A fixed number of passes as one plan (short runs and checks)."""
    for number in range(1, passes + 1):
        state = with_verdict(step(state), scale, number).filter("stays").drop("stays")
    return state


@dataclass
class Resolved:
    """state: query, reference, slen, prob, iter, n_aln. tallies: pass, alignments (left after it), multi (looked at),
    removed, settled (queries that it left one alignment)."""

    state: DataFrame
    tallies: DataFrame


def _weights(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """reference, slen, weight for the next pass.

    Alignments that this pass settles weigh as much as they have (fresh counts them); scaled by the next pass they have
    a mass of 1 each, which is in fixed from then on.
    """
    settles = F.col("stays") & (F.col("n_stay") == 1)
    zero = F.lit(0.0)
    mass = F.when(F.col("stays"), F.col("prob")).otherwise(zero)
    parts = rows.select("reference", "slen", mass.alias("active"), zero.alias("fixed"), F.when(settles, 1.0).otherwise(zero).alias("fresh"))
    if before is not None:
        parts = parts.unionByName(before.select("reference", "slen", zero.alias("active"), (F.col("fixed") + F.col("fresh")).alias("fixed"), zero.alias("fresh")))
    per = parts.groupBy("reference").agg(F.first("slen").alias("slen"), *[F.sum(c).alias(c) for c in ("active", "fixed", "fresh")])
    return per.withColumn("weight", (F.col("active") + F.col("fixed")) / F.col("slen"))


def resolve(state: DataFrame, iters: int = 25, scale: float = 0.9, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """The state that resolve_passes ends with."""
    return resolve_passes(state, iters, scale, report).state


def resolve_passes(state: DataFrame, iters: int = 25, scale: float = 0.9, report: Callable[[int, int], None] | None = None, folder: str | None = None) -> Resolved:
    """Passes until nothing is removed, all queries are unique, or ``iters`` passes are done (0: no limit).

    A pass that finds every query unique ends the loop before any removal. Alignments that are their query's only one
    are settled: they leave the loop, and their mass stays in the weights. What is left rests in buckets by query, so a
    pass exchanges nothing but the weights, one row per reference; these are broadcast if they are few and joined by a
    shuffle if not. Each pass is a table that knows nothing of the passes before it (``Iteration``), and its tallies are
    observed while it is written. With a ``folder`` a run that was cut short goes on from its last pass.
    """
    spark = state.sparkSession
    work = Iteration(spark, folder, "em")
    n_stay = F.count(F.when(F.col("stays"), 1)).over(_by_query())
    settles = F.col("stays") & (F.col("n_stay") == 1)
    columns = ["query", "reference", "slen", "prob", "iter", F.col("n_stay").alias("n_aln")]

    def run(rows: DataFrame, number: int, buckets: int, weights: DataFrame | None, left: int) -> tuple[DataFrame, DataFrame, Row]:
        seen, known = Observation(), Observation()
        count = lambda condition: F.count(F.when(condition, 1))
        observed = rows.observe(seen, count(F.col("n_aln") > 1).alias("multi"), count(~F.col("stays")).alias("removed"), count(settles).alias("settled"), F.count(F.lit(1)).alias("rows"))
        now = work.write_bucketed(observed, "rows", number, "query", buckets)
        tally = seen.get
        left = left - tally["removed"] if number else tally["rows"]
        ended = number > 0 and (not tally["multi"] or not tally["removed"] or 0 < iters <= number)
        if not ended and (tally["settled"] or not number):  # another pass would scale what a query has left to 1
            work.write(now.filter(settles).select(*columns).withColumn("prob", F.lit(1.0)), "settled", number)
        weights = work.write(_weights(now, weights).observe(known, F.count(F.lit(1)).alias("references")), "weights", number)
        row = {"alignments": left, "multi": tally["multi"], "removed": tally["removed"], "settled": tally["settled"], "ended": ended, "references": known.get["references"], "buckets": buckets, "columns": ", ".join(f"`{c}` {t}" for c, t in now.dtypes)}
        work.commit(number, **row)
        for table in ("rows", "weights"):
            work.retire(table, number - 2)
        if report and number:
            report(number, tally["removed"])
        return now, weights, Row(**row)

    number = work.last()
    if number is None:
        number = 0
        first = state.withColumn("stays", F.lit(True)).withColumn("n_stay", n_stay)
        now, weights, tally = run(first, 0, int(spark.conf.get("spark.sql.shuffle.partitions")), None, 0)
    else:
        tally = work.tally(number)
        now, weights = work.read_bucketed("rows", number, tally["columns"], "query", tally["buckets"]), work.read("weights", number)
    while not tally["ended"]:
        number += 1
        active = now.filter("stays and n_stay > 1").select(*columns)
        known = weights.select("reference", "weight")
        small = tally["references"] <= BROADCAST_ROWS
        weighed = active.join(F.broadcast(known) if small else known, "reference").withColumn("new", F.col("prob") * F.col("weight"))
        stepped = weighed.select("query", "reference", "slen", (F.col("new") / F.sum("new").over(_by_query())).alias("prob"), "iter", "n_aln")
        # What is active has stayed in every pass; counted on, the code of all passes is the same and compiled once.
        now, weights, tally = run(with_verdict(stepped, scale, F.col("iter") + 1).withColumn("n_stay", n_stay), number, tally["buckets"], weights, tally["alignments"])
    last = now.filter("stays").select(*columns)
    settled = spark.read.schema(last.schema).parquet(*[work.path("settled", k) for k in range(number) if not k or work.tally(k)["settled"]])
    tallies = work.tallies().select("pass", "alignments", "multi", "removed", "settled")
    return Resolved(last.unionByName(settled), tallies)


def frequent_survivors(state: DataFrame, min_read_count: int) -> DataFrame:
    """Pairs of the references that keep enough of them."""
    enough = state.groupBy("reference").count().filter(F.col("count") >= min_read_count)
    return state.join(enough.select("reference"), "reference", "left_semi")


def surviving_alignments(alignments: DataFrame, state: DataFrame) -> DataFrame:
    """All records of the surviving pairs, also those that the filters had set aside."""
    pairs = state.select(F.col("query").alias("query_name"), "reference")
    return alignments.join(pairs, ["query_name", "reference"], "left_semi")
