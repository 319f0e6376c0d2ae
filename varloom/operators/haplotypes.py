"""Haplotypes of reads in a window: DataFrame forms of the spanning join, sums, order and mode, and the
in-group form that clustering and path search work on."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import kmer_counts
from .intervals import range_join


def spanning_reads(reads: DataFrame, hoods: DataFrame, dist: int, width: int = 1 << 14) -> DataFrame:
    """(chrom, ne, read_ord, ps, hp, pileups): reads that strictly span a neighbourhood's window
    [max(0, start - dist), end + dist], with the pileups inside it (both ends count).

    Only the bin of the window's start is needed, since a spanning read covers it; reads are the side that is
    copied to their bins.
    """
    windows = hoods.select("chrom", "ne", F.greatest(F.lit(0).cast("long"), F.col("start") - dist).alias("ws"), (F.col("end") + dist).alias("we"))
    spans = reads.select(F.col("chrom"), F.col("start").alias("__s"), F.col("end").alias("__e"), "read_ord", "ps", "hp", "pileups")
    hit = range_join(windows, spans, "chrom", F.col("ws"), "__s", "__e", (F.col("__s") < F.col("ws")) & (F.col("__e") > F.col("we")), width)
    inside = F.filter("pileups", lambda v: v["position"].between(F.col("ws"), F.col("we")))
    return hit.select("chrom", "ne", "read_ord", "ps", "hp", inside.alias("pileups"))


def near(reads: DataFrame, hoods: DataFrame) -> DataFrame:
    """reads that may span a neighbourhood: those of its contigs, between the first and the last of them. The bounds are a
    row a contig; as plain filters they reach the scan, which skips other contigs' folders and row groups."""
    hoods = hoods.groupBy("chrom").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).collect()
    contig = "contig" if "contig" in reads.columns else "chrom"
    wanted = F.lit(False)
    for r in hoods:
        wanted |= (F.col(contig) == r.chrom) & (F.col("start") < r.hi) & (F.col("end") > r.lo)
    return reads.where(wanted).drop("contig")


def coverage(spanning: DataFrame) -> DataFrame:
    """(chrom, ne, coverage, ps): spanning reads, with or without pileups, and the first phase set in read order."""
    first = F.min_by("ps", F.when(F.col("ps").isNotNull(), F.col("read_ord")))
    return spanning.groupBy("chrom", "ne").agg(F.count("*").alias("coverage"), first.alias("ps"))


def fill_deletions(spanning: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """spanning with the reference bases [position, end], both ends included, as the sequence of deletions.

    reference: (chrom, chunk_start, seq) in pieces of chunk bases. Distinct deletions fetch their pieces once.
    """
    rows = spanning.select("*", F.posexplode_outer("pileups").alias("__i", "v")).drop("pileups")
    need = rows.where("v.indel = 'Del'").select("chrom", F.col("v.position").alias("p"), F.col("v.end").alias("e")).distinct()
    need = need.withColumn("chunk_start", F.explode(F.sequence(F.floor(F.greatest(F.col("p"), F.lit(0)) / chunk) * chunk, F.floor(F.col("e") / chunk) * chunk, F.lit(chunk).cast("long"))))
    lo = F.greatest(F.col("p") - F.col("chunk_start"), F.lit(0)).cast("int")
    hi = F.least(F.col("e") - F.col("chunk_start") + 1, F.lit(chunk)).cast("int")
    piece = need.join(reference, ["chrom", "chunk_start"]).select("chrom", "p", "e", "chunk_start", F.substring("seq", lo + 1, hi - lo).alias("s"))
    bases = piece.groupBy("chrom", "p", "e").agg(F.array_sort(F.collect_list(F.struct("chunk_start", "s"))).alias("ss"))
    bases = bases.select(F.col("chrom").alias("__c"), "p", "e", F.array_join(F.transform("ss", lambda x: x["s"]), "").alias("bases"))
    got = rows.join(bases, (F.col("chrom") == F.col("__c")) & (F.col("v.position") == F.col("p")) & (F.col("v.end") == F.col("e")) & (F.col("v.indel") == "Del"), "left")
    full = F.when(F.col("v").isNotNull(), F.col("v").withField("sequence", F.coalesce("bases", "v.sequence")))
    again = got.groupBy("chrom", "ne", "read_ord", "ps", "hp").agg(F.array_sort(F.collect_list(F.when(full.isNotNull(), F.struct("__i", full.alias("v"))))).alias("vs"))
    return again.select("chrom", "ne", "read_ord", "ps", "hp", F.transform("vs", lambda x: x["v"]).alias("pileups"))


def sum_parts(parts: DataFrame, key: list[str], size: str, kfeat: str, width: int) -> DataFrame:
    """(key, size, n, kfeat): element-wise sums over the parts of a key, with partial aggregation a position."""
    sums = F.array(*[F.sum(F.col(kfeat)[i]) for i in range(width)])
    return parts.groupBy(*key).agg(F.sum(size).alias("size"), F.count("*").alias("n"), sums.alias("kfeat"))


def ordered(haps: DataFrame, key: list[str], order: str = "read_ord") -> DataFrame:
    """haps with `rank`: by coverage, fewer parts, size and features (negatives count as 0), best first; ties by
    read order."""
    clamped = F.transform("kfeat", lambda x: F.greatest(x, F.lit(0)))
    w = Window.partitionBy(*key).orderBy(F.desc("coverage"), F.asc("n"), F.desc("size"), clamped.desc(), F.asc(order))
    return haps.withColumn("rank", F.row_number().over(w))


def haploid_mode(haps: DataFrame, key: list[str], order: str = "read_ord") -> DataFrame:
    """The most frequent haplotype of each key; its coverage is that of all the key's haplotypes, its phase set
    the first one. Equal counts go to the larger haplotype (fewer parts, larger size and features)."""
    same = haps.groupBy(*key, "size", "n", "kfeat").agg(F.count("*").alias("__count"), F.min(order).alias("__first"))
    total = haps.groupBy(*key).agg(F.count("*").alias("coverage"), F.min_by("ps", F.when(F.col("ps").isNotNull(), F.col(order))).alias("ps"))
    clamped = F.transform("kfeat", lambda x: F.greatest(x, F.lit(0)))
    w = Window.partitionBy(*key).orderBy(F.desc("__count"), F.asc("n"), F.desc("size"), clamped.desc(), F.asc("__first"))
    best = same.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__count", "__first")
    return best.join(total, key)


def partial_sizes(parts: DataFrame, key: list[str], size: str, order: str, fnmax: int, pileupmax: int) -> DataFrame:
    """(key, m, partial, total): the summed size of every subset of a key's m parts that leaves out at most fnmax
    (none of all); a key of pileupmax parts or more has its whole sum only.

    Only those subsets are made: the parts left out are chosen in ascending order, and m stands for none. A subset carries
    what its parts left out add up to, not the parts.
    """
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    whole = parts.groupBy(*key).agg(F.count("*").alias("m"), F.array_sort(F.collect_list(F.struct(order, size))).alias("ps"))
    whole = whole.select(*key, "m", F.transform("ps", lambda x: x[size].cast("long")).alias("ps")).withColumn("__whole", add(F.col("ps")))
    none = {"__last": F.lit(-1).cast("long"), "__gone": F.lit(0).cast("long"), "partial": F.lit(0).cast("long")}
    small = whole.where(F.col("m") < pileupmax).withColumns(none)
    for _ in range(fnmax):
        small = small.withColumn("__last", F.explode(F.sequence(F.least(F.col("__last") + 1, "m"), "m")))
        part = F.get("ps", F.col("__last").cast("int"))
        out = F.col("__last") < F.col("m")
        small = small.withColumns({"__gone": F.when(out, F.col("__gone") + part).otherwise(F.col("__gone")), "partial": F.col("partial") + out.cast("long")})
    total = F.col("__whole") - F.col("__gone")
    out = small.where(F.col("partial") < F.col("m")).select(*key, "m", "partial", total.alias("total"))
    large = whole.where(F.col("m") >= pileupmax).select(*key, "m", F.lit(0).cast("long").alias("partial"), F.col("__whole").alias("total"))
    return out.unionByName(large)


# --- within a neighbourhood ---------------------------------------------------------------------


@dataclass
class Haplotype:
    size: int
    n: int
    coverage: int
    kfeat: np.ndarray
    parts: list[tuple[int, np.ndarray]] = field(default_factory=list)
    ps: int | None = None
    hp: int | None = None

    def sort_key(self) -> tuple:
        return (-self.coverage, self.n, -self.size, tuple(-np.maximum(self.kfeat, 0)))


def build_haplotypes(reads: Iterable[tuple], k: int, longest: int) -> tuple[list[Haplotype], int]:
    """(haplotypes, coverage) of (ps, hp, [(position, size, indel, sequence)]) in read order; the phase set is the
    first one seen. Each distinct pileup is counted into k-mers once."""
    rows = list(reads)
    ps = next((r[0] for r in rows if r[0] is not None), None)
    known: dict[tuple, tuple[int, np.ndarray]] = {}
    out = []
    for _, hp, pileups in rows:
        if not pileups:
            continue
        parts = []
        for v in pileups:
            position, size, indel, sequence = v
            name = (position, size, indel, sequence if indel == "Ins" else None)
            if name not in known:
                known[name] = (size, kmer_counts((sequence or "").encode(), k, indel == "Del", longest))
            parts.append(known[name])
        feature = np.sum([f for _, f in parts], axis=0, dtype=np.float32)
        out.append(Haplotype(sum(s for s, _ in parts), len(parts), 1, feature, parts, ps, hp))
    out.sort(key=Haplotype.sort_key)
    return out, len(rows)
