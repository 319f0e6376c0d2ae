"""Command line: `gt` genotypes a VCF, `plup` indexes reads."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators import intervals
from .params import GenotypeParams, PileupParams
from .plans import genotype
from .sources import text

log = logging.getLogger("varloom")


def _add(parser: argparse.ArgumentParser, kind: type) -> None:
    for f in fields(kind):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            parser.add_argument(name, action="store_true")
        else:
            parser.add_argument(name, type=type(f.default), default=f.default)


def _params(kind: type, args: argparse.Namespace):
    return kind(**{f.name: getattr(args, f.name) for f in fields(kind)})


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="varloom")
    sub = parser.add_subparsers(dest="command", required=True)
    gt = sub.add_parser("gt", help="genotype the variants of a VCF from reads")
    for name in ("input", "reads", "reference", "out"):
        gt.add_argument(f"--{name}", required=True)
    for name in ("bed", "ploidy-bed", "sample"):
        gt.add_argument(f"--{name}")
    _add(gt, GenotypeParams)
    plup = sub.add_parser("plup", help="index reads")
    plup.add_argument("--reads", required=True)
    plup.add_argument("--out", required=True)
    _add(plup, PileupParams)
    return parser


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = build_parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("varloom").getOrCreate()
    _require(spark, *[getattr(args, n) for n in ("input", "reads", "reference", "bed", "ploidy_bed") if getattr(args, n, None)])
    if args.command == "plup":
        p = _params(PileupParams, args)
        reads = genotype.index_reads(text.read_alignments(spark, args.reads, p.chunk_mbp), p)
        (text.write_index if args.out.endswith(".parquet") else text.write_plup)(reads, args.out, p)
        return
    p = _params(GenotypeParams, args).validate()
    contigs = text.read_contigs(spark, args.input)
    regions = intervals.bed_regions(contigs, text.read_bed(spark, args.bed)) if args.bed else intervals.contig_regions(contigs)
    ploidy = text.read_ploidy(spark, args.ploidy_bed) if args.ploidy_bed else None
    done = genotype.genotype(text.read_vcf(spark, args.input), text.read_reads(spark, args.reads, p), regions, p, ploidy, text.read_fasta(spark, args.reference))
    tally = Observation("genotypes")
    counts = [F.count_if(F.col("gt_state") == s).alias(s) for s in ("Ref", "Het", "Hom", "Non")]
    done = done.observe(tally, F.count("*").alias("records"), F.count_if(F.col("node").isNull()).alias("skipped"), F.count_if(F.col("node") == 1).alias("neighborhoods"), *counts)
    text.write_vcf(done, args.out, text.read_vcf_header(spark, args.input), args.sample)
    log.info("genotyped: %s", ", ".join(f"{k} {v}" for k, v in tally.get.items()))


def _require(spark: SparkSession, *paths: str) -> None:
    """Stops before any work if an input is missing."""
    for path in (x for p in paths for x in (p.split(",") if p.endswith(".bam") else [p])):
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name):
            raise FileNotFoundError(path)


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    run()
