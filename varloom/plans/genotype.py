"""Whole genotyping and indexing plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import kmer_counts
from ..operators import annotate, cluster, haplotypes, intervals, neighborhoods, pathsearch, pileup, variants
from ..params import GenotypeParams, PileupParams

FOUND = f"chrom string, ne bigint, coverage bigint, paths {annotate.PATHS}"


def find_paths(nodes: DataFrame, spanning: DataFrame, p: GenotypeParams) -> DataFrame:
    """(chrom, ne, coverage, paths) of every neighbourhood: haplotypes clustered and traced in its graph.

    nodes: (chrom, ne, node, start, end, delta, ref, alt, ploidy); spanning: reads with pileups. Both sides meet
    by one shuffle on (chrom, ne).
    """

    import pyarrow as pa

    def trace(left, right):
        if not len(left):
            return pa.table({n: pa.array([], k) for n, k in kinds.items()})
        left, right = left.sort_by("node").to_pydict(), right.sort_by("read_ord").combine_chunks()
        lists = right.column("pileups").combine_chunks() if len(right) else pa.array([], pa.list_(pa.null()))
        values = lists.flatten()
        items = list(zip(*(values.field(n).to_pylist() for n in ("position", "size", "indel", "sequence")), strict=True)) if len(values) else []
        cut = np.concatenate([[0], np.cumsum([n or 0 for n in lists.value_lengths().to_pylist()])]).astype(int).tolist()
        rows = [(ps, hp, items[a:b]) for ps, hp, a, b in zip(right.column("ps").to_pylist(), right.column("hp").to_pylist(), cut[:-1], cut[1:], strict=True)]
        haps, cov = haplotypes.build_haplotypes(rows, p.kmer, p.maxhom)
        haps = cluster.haploid(haps) if left["ploidy"][0] == "Haploid" else cluster.diploid(haps, cov, p)
        count = lambda seq: kmer_counts(seq[1:].encode(), p.kmer, longest=p.maxhom)
        start, end, delta, ref, alt = (left[n] for n in ("start", "end", "delta", "ref", "alt"))
        graph = pathsearch.Graph(start, end, delta, np.stack([count(x) - count(r) for r, x in zip(ref, alt, strict=True)]))
        got = pathsearch.paths_of(graph, haps, p)
        return pa.table({"chrom": pa.array([left["chrom"][0]], pa.string()), "ne": pa.array([left["ne"][0]], pa.int64()), "coverage": pa.array([cov], pa.int64()), "paths": pa.array([got], kinds["paths"])})

    path = [("score", pa.float32()), ("sizesim", pa.float32()), ("seqsim", pa.float32()), ("path", pa.list_(pa.int32())), ("full_target", pa.bool_()), ("coverage", pa.int64()), ("ps", pa.int64()), ("hp", pa.int32())]
    kinds = {"chrom": pa.string(), "ne": pa.int64(), "coverage": pa.int64(), "paths": pa.list_(pa.struct(path))}
    spanning = spanning.select(*[F.col(c).alias(c) for c in spanning.columns])  # both sides may come from one table
    return nodes.groupBy("chrom", "ne").cogroup(spanning.groupBy("chrom", "ne")).applyInArrow(trace, FOUND)


def genotype(records: DataFrame, reads: DataFrame, regions: DataFrame, p: GenotypeParams, ploidy: DataFrame | None = None, reference: DataFrame | None = None, chunk: int = 1 << 16) -> DataFrame:
    """All records with genotype columns. reads: as indexed (with pileups); reference: needed if reads hold
    deletions. Rejected records come back without a genotype, those of ploidy 0 without reads looked at."""
    p.validate()
    flagged = variants.flag_keep(variants.derive(records), regions, p)
    kept = neighborhoods.number_nodes(neighborhoods.binned_neighborhoods(flagged.where("keep"), p.neighdist, 1 << 22))
    hoods = neighborhoods.bounds(kept)
    if ploidy is not None:
        named = intervals.interval_lookup(hoods, ploidy, ["chrom", "ne"], "chrom", "start", "ploidy", 1 << 20)
    else:
        named = hoods.withColumn("ploidy", F.lit(None).cast("string"))
    named = named.select("chrom", "ne", "start", "end", F.coalesce("ploidy", F.lit("Unset")).alias("ploidy"))
    live = named.where("ploidy <> 'Zero'")
    if "contig" in reads.columns:  # an index by contig and place: only what the neighbourhoods need is scanned
        reads = haplotypes.near(reads, live)
    spanning = haplotypes.spanning_reads(reads, live, p.neighdist)
    if reference is not None:
        spanning = haplotypes.fill_deletions(spanning, reference, chunk)
    nodes = kept.join(live.select("chrom", "ne", "ploidy"), ["chrom", "ne"])
    found = find_paths(nodes.select("chrom", "ne", "node", "start", "end", "delta", "ref", "alt", "ploidy"), spanning, p)
    found = named.select("chrom", "ne", "ploidy").join(found, ["chrom", "ne"], "left")
    done = annotate.annotate(kept, found)
    return done.unionByName(annotate.unannotated(flagged.where("not keep")).select(*done.columns))


def index_reads(reads: DataFrame, p: PileupParams) -> DataFrame:
    """The reads of a pileup index."""
    return pileup.reads_to_pileups(reads, p.validate())
