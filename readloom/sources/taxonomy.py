"""Taxonomy dumps (nodes, names), accession tables, reference lengths and statistics read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LENGTHS
from ..operators.tree import doubled, walks


def _dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    fields = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*[F.trim(fields[i]).alias(c) for i, c in enumerate(columns)])


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """taxid, parent, rank of a nodes dump (fields between TAB | TAB)."""
    x = _dump(spark, path, ["taxid", "parent", "rank"])
    return x.select(F.col("taxid").cast("bigint").alias("taxid"), F.col("parent").cast("bigint").alias("parent"), "rank")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """taxid, name: the scientific names of a names dump."""
    x = _dump(spark, path, ["taxid", "name", "unique_name", "class"]).filter("class = 'scientific name'")
    return x.select(F.col("taxid").cast("bigint").alias("taxid"), "name")


def read_accessions(spark: SparkSession, path: str, custom: bool = False) -> DataFrame:
    """reference, taxid of a table with header; keyed by accession.version, or accession for custom ones."""
    x = spark.read.option("header", True).option("sep", "\t").csv(path)
    return x.select(F.col("accession" if custom else "`accession.version`").alias("reference"), F.col("taxid").cast("bigint").alias("taxid"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """reference, length of a table without header."""
    return spark.read.schema(LENGTHS).option("sep", "\t").csv(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """What the LCA needs of a statistics table."""
    x = spark.read.option("header", True).option("sep", "\t").csv(path)
    return x.select("reference", F.col("n_reads").cast("bigint").alias("n_reads"), F.col("n_reads_tad").cast("bigint").alias("n_reads_tad"), F.col("coverage_mean_trunc_len").cast("double").alias("coverage_mean_trunc_len"))


def lineages(taxids: DataFrame, nodes: DataFrame, names: DataFrame, most: int = 1000) -> DataFrame:
    """taxid, lineage (map of rank to name, from the taxid up) of the given taxids.

    Ancestors come by pointer doubling; a taxid with more than ``most`` of them is an error, as only a taxonomy with a
    cycle has one. Where a rank occurs more than once (as ``clade`` does), it stands at its lowest place with its
    highest name.
    """
    named = nodes.join(names, "taxid").select(F.col("taxid").alias("at"), F.when(F.col("parent") != F.col("taxid"), F.col("parent")).alias("up"), "rank", "name")
    ways = walks(taxids.select(F.col("taxid").alias("start")), doubled(named.select(F.col("at").alias("node"), "up"), most))
    every = ways.join(named, "at").select(F.col("start").alias("taxid"), "rank", "name", "depth")
    known = every.filter("rank <> 'no rank'")
    once = known.groupBy("taxid", "rank").agg(F.min("depth").alias("depth"), F.max_by("name", "depth").alias("name"))
    # A lineage has at most as many ranks as there are.
    ordered = once.groupBy("taxid").agg(F.sort_array(F.collect_list(F.struct("depth", "rank", "name"))).alias("x"))
    return ordered.select("taxid", F.map_from_entries(F.transform("x", lambda s: F.struct(s["rank"], s["name"]))).alias("lineage"))


def reference_lineages(references: DataFrame, accessions: DataFrame, nodes: DataFrame, names: DataFrame, custom: bool = False) -> DataFrame:
    """reference, header_order, lineage of the references that the accession table and the taxonomy know."""
    wanted = references.join(accessions, "reference").select("reference", "header_order", "taxid")
    x = wanted.join(lineages(wanted.select("taxid"), nodes, names), "taxid")
    if custom:
        # The reference itself is a subspecies: in the place of that rank, or after the others where there is none.
        own = F.concat(F.lit("S__"), "reference")
        renamed = F.transform_values("lineage", lambda k, v: F.when(k == "subspecies", own).otherwise(v))
        added = F.map_concat("lineage", F.map_from_arrays(F.array(F.lit("subspecies")), F.array(own)))
        x = x.withColumn("lineage", F.when(F.map_contains_key("lineage", "subspecies"), renamed).otherwise(added))
    return x.select("reference", "header_order", "lineage")


def rank_template(found: DataFrame) -> list[str]:
    """Ranks from broad to narrow of the first annotated reference; all others must have them."""
    first = found.orderBy("header_order", "reference").select(F.map_keys("lineage")).first()
    return list(reversed(first[0])) if first else []
