"""Command line: import, preprocess, thresholds, mask, export and pca on stores."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import histogram, masks, pca
from .operators import track as T
from .plans import rewrite
from .plans.selection import Coordinates, Genome
from .sources import files
from .sources.store import Entry, Store

# Defaults of the commands; the environment may give others.
MAX_POSITIONS = int(os.environ.get("BASETRACK_MAX_POSITIONS", 50_000_000))
PCA_WINDOW = int(os.environ.get("BASETRACK_PCA_WINDOW_SIZE", 10_000))

def _genome(path: str) -> Genome:
    with open(path) as f:
        return Genome.of((a, int(b)) for a, b in (line.split("\t" if "\t" in line else None)[:2] for line in f if line.strip()))


def _new(path: str, force: bool) -> None:
    if os.path.exists(path) and not force:
        raise SystemExit(f"{path} exists; give --force to overwrite it")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="basetrack")
    p.add_argument("--version", action="version", version=f"basetrack {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("import")
    a.add_argument("store")
    a.add_argument("genome", help="table of contig and length")
    a.add_argument("files", nargs="*")
    a.add_argument("--track-name", default="depth")
    a.add_argument("--chunk-size", type=int, help="positions of a file")
    a = sub.add_parser("version")
    a = sub.add_parser("preprocess")
    a.add_argument("store")
    a.add_argument("what", choices=["all", "sum", "missingness"])
    a.add_argument("--sampleset-info")
    a.add_argument("--missing-data-threshold", type=int, action="append")
    a.add_argument("--track-name", default="depth")
    a = sub.add_parser("thresholds")
    a.add_argument("store")
    a.add_argument("-o", "--output")
    a.add_argument("--force", action="store_true")
    a.add_argument("--missing-data-threshold", "--threshold", type=int, default=3)
    a.add_argument("--max-positions", type=int, default=MAX_POSITIONS)
    a.add_argument("--track-name", default="depth")
    a = sub.add_parser("mask")
    a.add_argument("store")
    a.add_argument("thresholds")
    a.add_argument("output")
    a.add_argument("--cutoff", type=int, action="append")
    a.add_argument("--positions", action="store_true", help="a row for each position and set instead of runs")
    a.add_argument("--track-name", default="depth")
    a = sub.add_parser("export")
    a.add_argument("mask")
    a.add_argument("output")
    a.add_argument("-O", "--format", choices=["BED", "FASTA"], default="BED")
    a.add_argument("--layer", default="accessible", choices=["accessible", "excluded_coverage", "excluded_missing"])
    a.add_argument("--sampleset-name", default="ALL")
    a.add_argument("--cutoff", type=int)
    a.add_argument("--genome", help="table of contig and length, for FASTA")
    a.add_argument("--parts", action="store_true", help="a folder of files in order, written by all executors, instead of one file")
    a = sub.add_parser("pca")
    a.add_argument("store")
    a.add_argument("-o", "--output", required=True)
    a.add_argument("--window-size", type=int, default=PCA_WINDOW)
    a.add_argument("--n-components", type=int, default=10)
    a.add_argument("--min-contig-length", type=int, default=0)
    a.add_argument("--max-contig-length", type=int, default=1 << 62)
    a.add_argument("--sample-set", action="append")
    a.add_argument("--force", action="store_true")
    a.add_argument("--track-name", default="depth")
    args = p.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    spark = SparkSession.builder.getOrCreate()
    return globals()[f"_{args.command}"](spark, args)


def _import(spark, args) -> int:
    if not args.files:
        print("no input files", file=sys.stderr)
        return 0
    genome = _genome(args.genome)
    names = [files.sample_name(f) for f in args.files]
    store = Store.create(spark, args.store)
    store.write(Entry(args.track_name, names, list(genome.contigs), list(genome.offsets)), files.import_tracks(spark, args.files, genome), chunk_size=args.chunk_size)
    return 0


def _preprocess(spark, args) -> int:
    store = Store.open(spark, args.store)
    labels = store.entries[args.track_name].labels
    grouping = files.sample_sets(spark, args.sampleset_info, labels) if args.sampleset_info else None
    cutoffs = [] if args.what == "sum" else args.missing_data_threshold or [3]
    print("\n".join(store.preprocess(args.track_name, grouping, cutoffs, args.what != "missingness")))
    return 0


def _thresholds(spark, args) -> int:
    store = Store.open(spark, args.store)
    store.summary(args.track_name, "missing", args.missing_data_threshold)
    entry = store.entries[args.track_name]
    grouping = entry.grouping()
    hist = rewrite.sum_hists(store, args.track_name, args.max_positions).withColumnRenamed("selection", "sample_set")
    limits = histogram.thresholds(hist)
    histogram.threshold_table(hist, limits, grouping, entry.genome.size).show(100, False)
    if args.output:
        _new(args.output, args.force)
        with open(args.output, "w") as f:
            f.write(files.profile_to_yaml(files.default_profile(limits, grouping, args.missing_data_threshold), store.identity()))
    return 0


def _mask(spark, args) -> int:
    store = Store.open(spark, args.store)
    with open(args.thresholds) as f:
        profile, dataset = files.profile_from_yaml(f.read())
    if dataset != store.identity():
        print("warning: the profile was made for another store or other sample sets", file=sys.stderr)
    for k in args.cutoff or sorted({q["missing_cutoff"] for q in profile.values()}):
        store.summary(args.track_name, "missing", k)
    made = rewrite.mask_layers if args.positions else rewrite.mask_runs
    files.write_mask(made(store, args.track_name, profile, args.cutoff), args.output, profile, dataset, args.cutoff)
    return 0


def _export(spark, args) -> int:
    mask = spark.read.parquet(args.mask)
    of_runs = "start" in mask.columns
    attributes = files.mask_attributes(spark, args.mask)
    profile = attributes["thresholds"]["sample_sets"]
    cutoffs, sets = masks.cutoffs_of(profile, attributes.get("missing_cutoffs")), sorted(profile)
    if args.sampleset_name not in sets:
        raise SystemExit(f"unknown sample set {args.sampleset_name}; there are {', '.join(sets)}")
    if args.layer == "excluded_coverage" and args.cutoff is not None:
        raise SystemExit("excluded_coverage has no cutoff")
    if args.layer != "excluded_coverage" and args.cutoff is None and len(cutoffs) > 1:
        raise SystemExit(f"one of these cutoffs is needed: {', '.join(map(str, cutoffs))}")
    k = cutoffs[0] if args.cutoff is None else args.cutoff
    if k not in cutoffs:
        raise SystemExit(f"unknown cutoff {k}; there are {', '.join(map(str, cutoffs))}")
    rows = mask.where(mask["sample_set"] == args.sampleset_name)
    if of_runs:
        rows = rows.where((mask["layer"] == args.layer) & F.coalesce(mask["missing_cutoff"] == k, F.lit(True)))
    else:
        rows = rows.where(mask["missing_cutoff"] == k).withColumn("accessible", mask[args.layer])
    lines = files.bed(rows) if args.format == "BED" else files.fasta(rows, _genome(args.genome))
    if args.parts:
        lines.write.text(args.output)
    else:
        files.write_lines(lines, args.output)
    return 0


def _pca(spark, args) -> int:
    store = Store.open(spark, args.store)
    entry = store.entries[args.track_name]
    grouping = entry.grouping()
    contigs = entry.genome.in_length_range(args.min_contig_length, args.max_contig_length)
    resolved = Coordinates().with_contigs(contigs).with_sample_sets(args.sample_set).resolve(entry.genome, grouping)
    names = [f"{args.output}.scores.tsv", f"{args.output}.variance.tsv"]
    for name in names:
        _new(name, args.force)
    rows = store.read(args.track_name)
    where = T.at(resolved)
    result = pca.analyse(rows if where is None else rows.where(where), list(resolved.columns), args.window_size)
    for name, text in zip(names, files.pca_tables(result, args.n_components, grouping)):
        with open(name, "w") as f:
            f.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
