"""Reads to pileups: CIGAR walk, filters, and the text index's encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import bind
from ..params import GenotypeParams, PileupParams

PILEUP = "struct<position:bigint,end:bigint,indel:string,size:bigint,sequence:string>"


def read_filter(p: PileupParams | GenotypeParams, seq: str = "seq", mapq: str = "mapq", flags: str = "flags") -> Column:
    return (F.length(seq) > 0) & (F.col(mapq) >= p.mapq) & (F.col(flags).bitwiseAND(F.lit(p.mapflag)) == 0)


def tag(value: Column, allowed: tuple[int, ...] | None = None) -> Column:
    """Integer tag; absent, malformed or (if listed) not allowed is null."""
    number = value.try_cast("bigint")
    return F.when(number.isin(*allowed), number) if allowed else number


def cigar_ops(cigar: Column) -> Column:
    """struct<n: array<bigint>, op: array<string>>"""
    found = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return bind(found, lambda v: F.struct(F.transform(v, lambda x: F.substring(x, F.lit(1), F.length(x) - 1).cast("bigint")).alias("n"), F.transform(v, lambda x: F.right(x, F.lit(1))).alias("op")))


def _advance(ops: Column, count: Column | None, kinds: tuple[str, ...]) -> Column:
    """Summed lengths of the operations of some kinds, among the first `count` (all by default)."""
    n, op = (ops["n"], ops["op"]) if count is None else (F.slice(ops["n"], F.lit(1), count), F.slice(ops["op"], F.lit(1), count))
    return F.aggregate(F.zip_with(n, op, lambda a, b: F.when(b.isin(*kinds), a).otherwise(0)), F.lit(0).cast("bigint"), lambda t, x: t + x)


def walk_cigar(start: Column, cigar: Column, seq: Column, sizemin: int, sizemax: int) -> Column:
    return walk_ops(start, cigar_ops(cigar), seq, sizemin, sizemax)


def walk_ops(start: Column, ops: Column, seq: Column, sizemin: int, sizemax: int) -> Column:
    """array<PILEUP> of the insertions and deletions of a read with a size in bounds.

    The alignment offset starts one base left of the read; M, = and X advance both offsets, I and S the
    read's, D the alignment's; H, P and N neither. Operations in bounds are picked first, and offsets summed for them
    alone.
    """

    def pick(ops: Column) -> Column:
        wanted = F.filter(F.sequence(F.lit(0), F.size(ops["n"]) - 1), lambda i: ops["n"][i].between(sizemin, sizemax) & ops["op"][i].isin("I", "D"))
        wanted = F.when(F.size(ops["n"]) > 0, wanted).otherwise(F.array().cast("array<int>"))
        return F.transform(wanted, lambda i: bind(F.struct((start - 1 + _advance(ops, i, ("M", "=", "X", "D"))).cast("bigint").alias("at"), ops["n"][i].alias("n"), (ops["op"][i] == "I").alias("ins")), lambda v: F.struct(
            v["at"].alias("position"), (v["at"] + F.when(v["ins"], 1).otherwise(v["n"])).alias("end"), F.when(v["ins"], "Ins").otherwise("Del").alias("indel"), F.when(v["ins"], v["n"]).otherwise(-v["n"]).alias("size"),
            F.when(v["ins"], F.substring(seq, (1 + _advance(ops, i, ("M", "=", "X", "I", "S"))).cast("int"), v["n"].cast("int"))).alias("sequence"),
        )))

    return bind(ops, pick).cast(f"array<{PILEUP}>")


def aligned_end(start: Column, cigar: Column) -> Column:
    return ops_end(start, cigar_ops(cigar))


def ops_end(start: Column, ops: Column) -> Column:
    return start + _advance(ops, None, ("M", "=", "X", "D", "N"))


def reads_to_pileups(reads: DataFrame, p: PileupParams | GenotypeParams) -> DataFrame:
    """(chrom, start, end, pileups, ps, hp, read_ord) of the reads that pass; reads without pileups stay, as coverage."""
    rows = reads.where(read_filter(p)).withColumn("__ops", cigar_ops(F.col("cigar")))  # parsed once for both its uses
    return rows.select(
        "chrom", F.col("start").cast("bigint").alias("start"), ops_end(F.col("start").cast("bigint"), F.col("__ops")).alias("end"),
        walk_ops(F.col("start"), F.col("__ops"), F.col("seq"), p.sizemin, p.sizemax).alias("pileups"),
        tag(F.col("ps")).alias("ps"), tag(F.col("hp"), (1, 2)).cast("int").alias("hp"), "read_ord",
    )


def encode_pileups(start: Column, pileups: Column) -> Column:
    """`offset:length` of deletions and `offset:SEQ` of insertions, by commas; '.' for none."""
    one = lambda v: F.concat((v["position"] - start).cast("string"), F.lit(":"), F.when(v["indel"] == "Del", F.abs(v["size"]).cast("string")).otherwise(v["sequence"]))
    return F.when(F.size(pileups) == 0, ".").otherwise(F.array_join(F.transform(pileups, one), ","))


def decode_pileups(start: Column, text: Column, sizemin: int, sizemax: int) -> Column:
    """array<PILEUP>; malformed items and sizes out of bounds are dropped. A number is a deletion."""
    items = F.regexp_extract_all(text, F.lit("(?:^|,)([0-9]+:(?:[0-9]+|[A-Za-z=.*]+))(?=,|$)"), F.lit(1))

    def one(offset: Column, value: Column) -> Column:
        made = lambda v: F.struct(
            v["at"].alias("position"), (v["at"] + F.coalesce(v["cut"], F.lit(1))).alias("end"), F.when(v["cut"].isNull(), "Ins").otherwise("Del").alias("indel"),
            F.coalesce(-v["cut"], F.length(value).cast("bigint")).alias("size"), F.when(v["cut"].isNull(), value).alias("sequence"),
        )
        return bind(F.struct((start + offset.try_cast("bigint")).alias("at"), value.try_cast("bigint").alias("cut")), made)

    found = F.transform(items, lambda x: bind(F.split(x, ":"), lambda v: one(v[0], v[1])))
    return F.filter(found, lambda v: v["position"].isNotNull() & F.abs(v["size"]).between(sizemin, sizemax)).cast(f"array<{PILEUP}>")


def encode_reads(reads: DataFrame) -> DataFrame:
    """(chrom, start, line) of the text index: six columns, '.' for nothing."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), encode_pileups(F.col("start"), F.col("pileups")), dot("ps"), dot("hp"))
    return reads.select("chrom", "start", line.alias("line"))


def decode_reads(lines: DataFrame, sizemin: int, sizemax: int, line: str = "value", order: str = "read_ord") -> DataFrame:
    """The reads of index lines; a line with a bad mandatory field is ignored, as are comments."""
    parts = lines.where(~F.col(line).startswith("#")).select(F.split(line, "\t").alias("f"), order)
    parts = parts.where(F.size("f") >= 6).select(
        F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("bigint").alias("start"), F.get("f", F.lit(2)).try_cast("bigint").alias("end"),
        F.get("f", F.lit(3)).alias("text"), tag(F.get("f", F.lit(4))).alias("ps"), tag(F.get("f", F.lit(5)), (1, 2)).cast("int").alias("hp"), order,
    )
    parts = parts.where("start is not null and end is not null")
    return parts.select("chrom", "start", "end", decode_pileups(F.col("start"), F.col("text"), sizemin, sizemax).alias("pileups"), "ps", "hp", order)
