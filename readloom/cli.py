"""Command line: ``python -m readloom.cli {filter,reassign,lca} --bam FILE ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import __version__
from .config import FilterConfig, LcaConfig, ReassignConfig, parse_size
from .plans import pipelines
from .sources import bam, sinks, taxonomy


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom", description=__doc__)
    top.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    top.add_argument("--debug", action="store_true", help="log what Spark does")
    sub = top.add_subparsers(dest="action", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--bam", required=True, help="alignment file")
    shared.add_argument("-p", "--prefix", help="prefix of the outputs")
    shared.add_argument("-r", "--reference-lengths", help="table of reference lengths")
    shared.add_argument("-t", "--threads", type=int, default=1, help="local threads, where no cluster is configured")
    shared.add_argument("-m", "--sort-memory", default="1G", help="no effect: Spark sorts within its executors' memory and spills")
    shared.add_argument("--tmp-dir", help="folder for checkpoints, shared by driver and executors")

    def number(p: argparse.ArgumentParser, flags: str, dest: str, default: object, kind=float) -> None:
        p.add_argument(*flags.split(), dest=dest, type=kind, default=default)

    r = sub.add_parser("reassign", parents=[shared])
    d = ReassignConfig()
    for flags, dest, kind in (("-i --iters", "iters", int), ("-s --scale", "scale", float), ("-A --min-read-ani", "min_read_ani", float), ("-l --min-read-length", "min_read_length", int), ("-L --max-read-length", "max_read_length", float), ("-n --min-read-count", "min_read_count", int), ("--match-reward", "match_reward", int), ("--mismatch-penalty", "mismatch_penalty", int), ("--gap-open-penalty", "gap_open_penalty", int), ("--gap-extension-penalty", "gap_extension_penalty", int)):
        number(r, flags, dest, getattr(d, dest), kind)
    r.add_argument("-o", "--out-bam", nargs="?", const="")
    r.add_argument("-M", "--max-memory", help="no effect: each pass is spilled and checkpointed by Spark")
    f = sub.add_parser("filter", parents=[shared])
    d = FilterConfig()
    for flags, dest, kind in (("-A --min-read-ani", "min_read_ani", float), ("-l --min-read-length", "min_read_length", int), ("-L --max-read-length", "max_read_length", float), ("-n --min-read-count", "min_read_count", int), ("-b --min-expected-breadth-ratio", "min_expected_breadth_ratio", float), ("-e --min-normalized-entropy", "min_norm_entropy", str), ("-g --min-normalized-gini", "min_norm_gini", str), ("-B --min-breadth", "min_breadth", float), ("-a --min-avg-read-ani", "min_avg_read_ani", float), ("-c --min-coverage-evenness", "min_coverage_evenness", float), ("-V --min-coeff-var", "min_coeff_var", float), ("-C --min-coverage-mean", "min_coverage_mean", float), ("--reference-trim-length", "trim_ends", int), ("--trim-min", "trim_min", int), ("--trim-max", "trim_max", int)):
        number(f, flags, dest, getattr(d, dest), kind)
    f.add_argument("--include-low-detection", action="store_true")
    f.add_argument("--low-memory", action="store_true", help="keep the pre-filtered records as a sorted table on disk instead of reading the file once for each measure")
    for name in ("stats", "stats-filtered", "bam-filtered", "read-length-freqs", "read-hits-count", "knee-plot", "coverage-plots"):
        f.add_argument(f"--{name}", nargs="?", const="", help="default name if none is given")
    for p in (r, f):
        p.add_argument("--bam-layout", choices=("file", "files"), default="file", help="one file, or a folder of whole files that nothing but names passes the driver for")
        p.add_argument("-N", "--sort-by-name", action="store_true")
        p.add_argument("--disable-sort", action="store_true")
    f.add_argument("--scale", type=parse_size, default=1e6)
    a = sub.add_parser("lca", parents=[shared])
    for name in ("names", "nodes", "acc2taxid"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--lca-rank", default=LcaConfig().rank)
    a.add_argument("--lca-summary", nargs="?", const="")
    a.add_argument("--custom", action="store_true")
    a.add_argument("--stats")
    a.add_argument("--scale", type=parse_size, default=1e6)
    return top


def _write_bam(spark: SparkSession, args: argparse.Namespace, alignments, references, kept: list[str], path: str) -> None:
    order = "unsorted" if args.disable_sort else "queryname" if args.sort_by_name else "coordinate"
    out = alignments if args.disable_sort else bam.sort_alignments(alignments, references, args.sort_by_name)
    out.write.format("bam").mode("overwrite").option("header", args.bam).option("references", json.dumps(kept)).option("order", order).option("layout", args.bam_layout).save(path)


#: States of an input (bam.check_input) that end a command, and those that leave empty outputs.
BROKEN = {"no header", "truncated"}
NOTHING = {"empty", "no references", "no records"}


def outputs(args: argparse.Namespace, names: dict[str, str]) -> list[str]:
    """The files that a command was asked for."""
    asked = {
        "filter": {"stats": args.__dict__.get("stats") or "", "stats_filtered": args.__dict__.get("stats_filtered"), "bam_filtered": args.__dict__.get("bam_filtered"), "read_hits_count": args.__dict__.get("read_hits_count"), "read_length_freqs": args.__dict__.get("read_length_freqs"), "knee": args.__dict__.get("knee_plot")},
        "reassign": {"bam_reassigned": args.__dict__.get("out_bam") or ""},
        "lca": {"lca_summary": args.__dict__.get("lca_summary") or ""},
    }[args.action]
    return [value or names[key] for key, value in asked.items() if value is not None]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    names = sinks.output_names(args.bam, args.prefix)
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{args.threads}]").appName("readloom").getOrCreate()
    if args.debug:
        spark.sparkContext.setLogLevel("INFO")
    if args.tmp_dir:
        spark.sparkContext.setCheckpointDir(args.tmp_dir)
    bam.register(spark)
    states = {s for _, s in bam.check_input(spark, args.bam)}
    if states & BROKEN:
        print(f"{args.bam}: {', '.join(sorted(states & BROKEN))}", file=sys.stderr)
        return 1
    if states <= NOTHING:
        sinks.write_empty(outputs(args, names))
        return 0
    references = bam.read_references(spark, args.bam)
    alignments = spark.read.format("bam").load(args.bam)
    lean = spark.read.format("bam").option("raw", "false").load(args.bam)  # without what only the writer needs
    lengths = taxonomy.read_lengths(spark, args.reference_lengths) if args.reference_lengths else None
    pick = lambda value, key: value or names[key]
    if args.action == "filter":
        fields = FilterConfig.__dataclass_fields__
        options = {k: v for k, v in vars(args).items() if k in fields and k not in ("read_length_freqs", "read_hits_count")}
        config = FilterConfig(**options, read_length_freqs=args.read_length_freqs is not None, read_hits_count=args.read_hits_count is not None)
        if args.bam_filtered is not None and args.stats_filtered is None:
            parser().error("--bam-filtered needs --stats-filtered")
        needs_records = args.bam_filtered is not None
        # Only statistics: columns that none of them reads are not stored.
        records = alignments if needs_records else lean.drop(*bam.UNMEASURED)
        counts = bam.index_counts(spark, args.bam) if bam.has_indexes(args.bam) else None
        result = pipelines.filter_references(records, references, config, lengths, args.low_memory, counts)
        sinks.write_tsv(result.stats, pick(args.stats, "stats"), ("reference",))
        if args.stats_filtered is not None:
            sinks.write_tsv(result.passing, pick(args.stats_filtered, "stats_filtered"), ("reference",), blank=True)
        if result.read_hits is not None:
            sinks.write_read_hits(result.read_hits, pick(args.read_hits_count, "read_hits_count"))
        if result.read_length_freqs is not None:
            sinks.write_read_length_freqs(result.read_length_freqs, pick(args.read_length_freqs, "read_length_freqs"))
        if args.knee_plot is not None:
            from .operators.refilter import knee_curve

            sinks.write_tsv(knee_curve(result.stats), pick(args.knee_plot, "knee"), blank=True)
        if args.coverage_plots is not None:
            from .operators import align, coverage

            segs = coverage.segments(align.filter_by_ani(lean, config.min_read_ani), references)
            sinks.write_tsv(coverage.clip(segs, references), pick(args.coverage_plots, "coverage"), one_file=False)
        if args.bam_filtered is not None:
            kept = [r[0] for r in result.passing.select("reference").collect()]  # a header's worth of names
            _write_bam(spark, args, result.alignments, references, kept, pick(args.bam_filtered, "bam_filtered"))
    elif args.action == "reassign":
        options = {k: v for k, v in vars(args).items() if k in ReassignConfig.__dataclass_fields__}
        result = pipelines.reassign(alignments, references, ReassignConfig(**options), lengths)
        kept = [r[0] for r in result.pairs.select("reference").distinct().collect()]
        _write_bam(spark, args, result.alignments, references, kept, pick(args.out_bam, "bam_reassigned"))
    else:
        stats = taxonomy.read_stats(spark, args.stats) if args.stats else None
        summary = pipelines.lca_summary(lean, references, taxonomy.read_accessions(spark, args.acc2taxid, args.custom), taxonomy.read_nodes(spark, args.nodes), taxonomy.read_names(spark, args.names), LcaConfig(args.lca_rank, args.scale, args.custom), lengths, stats)
        sinks.write_tsv(summary, pick(args.lca_summary, "lca_summary"), ("tax_path",), blank=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
