"""Alignments, references and a taxonomy as views over the driver's order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str, reference: str = "l_partkey") -> DataFrame:
    """Order lines as alignments of orders (reads) to parts or suppliers (references)."""
    length = F.lit(30) + F.col("l_quantity").cast("int")
    nm = F.round(F.col("l_discount") * 100).cast("int")
    start = F.datediff(F.col("l_shipdate"), F.lit("1995-01-02").cast("date")).cast("bigint")
    missing_score = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    gap = lambda n: F.when(F.col("l_linestatus") != "O", F.col("l_linenumber") % n).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("query_name"),
        F.col(reference).cast("string").alias("reference"),
        start.alias("reference_start"),
        (start + length).alias("reference_end"),
        (F.col("l_linenumber") % 2 == 0).alias("is_reverse"),
        F.when(F.col("l_linenumber") == 7, 255).otherwise(F.col("l_linenumber") * 5).alias("mapping_quality"),
        F.lit(None).cast("string").alias("query_sequence"),
        length.alias("query_length"),
        length.alias("inferred_query_length"),
        length.alias("inferred_read_length"),
        length.alias("query_alignment_length"),
        nm.alias("nm"),
        F.when(~missing_score, length - 2 * nm).alias("as_score"),
        gap(2).alias("xo"),
        gap(3).alias("xg"),
    )


def part_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("reference"), F.lit(2600).cast("bigint").alias("bam_reference_length"), F.lit(2600).cast("bigint").alias("reference_length"))


def supplier_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = (F.lit(1000) + F.col("s_suppkey") * 37 % 5000).cast("bigint")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("reference"), length.alias("bam_reference_length"), length.alias("reference_length"))


def supplier_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and supplier as ranks of a taxonomy."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").cast("string").alias("reference"), F.array(F.lit("root"), "r_name", "n_name", F.col("s_suppkey").cast("string")).alias("path"))


def ordered_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as references of a header."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("reference"), F.col("s_suppkey").cast("int").alias("header_order"))


def taxonomy_dump(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accessions (reference, taxid), nodes (taxid, parent, rank) and names (taxid, name), as a taxonomy dump has them.

    Suppliers are species of their nation (genus), which stands in two clades, one within the other, of its region.
    """
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    row = lambda taxid, parent, rank, name: F.struct(F.expr(taxid).cast("bigint").alias("taxid"), F.expr(parent).cast("bigint").alias("parent"), F.lit(rank).alias("rank"), F.expr(name).alias("name"))
    nations = [("n_nationkey + 100", "n_regionkey + 10", "clade", "concat('outer ', n_name)"), ("n_nationkey + 200", "n_nationkey + 100", "clade", "concat('inner ', n_name)"), ("n_nationkey + 300", "n_nationkey + 200", "genus", "n_name")]
    rows = [
        spark.range(1).select(row("1", "1", "no rank", "'root'").alias("x")),
        r.select(row("r_regionkey + 10", "1", "superkingdom", "r_name").alias("x")),
        n.select(F.explode(F.array(*[row(*f) for f in nations])).alias("x")),
        s.select(row("s_suppkey + 10000", "s_nationkey + 300", "species", "s_name").alias("x")),
    ]
    dump = rows[0]
    for more in rows[1:]:
        dump = dump.unionByName(more)
    dump = dump.select("x.*")
    accessions = s.select(F.col("s_suppkey").cast("string").alias("reference"), (F.col("s_suppkey") + 10000).cast("bigint").alias("taxid"))
    return accessions, dump.select("taxid", "parent", "rank"), dump.select("taxid", "name")


#: The same views in DuckDB.
SQL_ALIGNMENTS = """aln AS (
  SELECT cast(l_orderkey AS varchar) AS query_name, cast({reference} AS varchar) AS reference,
    cast(date_diff('day', timestamp '1995-01-02', l_shipdate) AS bigint) AS reference_start,
    cast(date_diff('day', timestamp '1995-01-02', l_shipdate) AS bigint) + 30 + cast(l_quantity AS integer) AS reference_end,
    CASE WHEN l_linenumber = 7 THEN 255 ELSE l_linenumber * 5 END AS mapping_quality,
    30 + cast(l_quantity AS integer) AS len, cast(round(l_discount * 100) AS integer) AS nm,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE 30 + cast(l_quantity AS integer) - 2 * cast(round(l_discount * 100) AS integer) END AS as_score,
    CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linenumber % 2 END AS xo, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linenumber % 3 END AS xg,
    (1 - cast(round(l_discount * 100) AS double) / (30 + cast(l_quantity AS integer))) * 100 AS ani
  FROM lineitem)"""


def sql_alignments(reference: str = "l_partkey") -> str:
    return SQL_ALIGNMENTS.format(reference=reference)


SQL_SUPPLIERS = "refs AS (SELECT cast(s_suppkey AS varchar) AS reference, cast(1000 + s_suppkey * 37 % 5000 AS bigint) AS reference_length FROM supplier)"
SQL_PATHS = """paths AS (
  SELECT cast(s_suppkey AS varchar) AS reference, 'root' AS n0, r_name AS n1, n_name AS n2, cast(s_suppkey AS varchar) AS n3
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_DUMP = """dump AS (SELECT 1 AS taxid, 1 AS parent, 'no rank' AS rank, 'root' AS name UNION ALL SELECT r_regionkey + 10, 1, 'superkingdom', r_name FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'clade', 'outer ' || n_name FROM nation UNION ALL SELECT n_nationkey + 200, n_nationkey + 100, 'clade', 'inner ' || n_name FROM nation
  UNION ALL SELECT n_nationkey + 300, n_nationkey + 200, 'genus', n_name FROM nation UNION ALL SELECT s_suppkey + 10000, s_nationkey + 300, 'species', s_name FROM supplier),
nodes AS (SELECT taxid, parent, rank FROM dump), names AS (SELECT taxid, name FROM dump)"""
