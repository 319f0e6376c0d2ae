"""Sources and sinks on files made from the star-schema tables: written to the shared folder, read back, beside the SQL
that says the same of the tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import haplotypes, pileup
from ..params import GenotypeParams, PileupParams
from ..sources import text
from .table_queries import QUERIES, _letters, query, table

__all__ = ["QUERIES"]

_PART = 250_000  # lines a part, sorted by one task


def _folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder all executors share; a temporary one only where they are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="varloom-files-")
    return f"{root.rstrip('/')}/varloom-{tag}-{uuid.uuid4().hex[:12]}"


def _written(lines: DataFrame, tag: str, *order: str) -> str:
    """Path of a folder of text: `line` in the given order, in as many parts as their number asks for."""
    path = _folder(lines.sparkSession, tag)
    parts = max(4, -(-lines.count() // _PART))
    lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("line").write.text(path)
    return path


@query("""
SELECT 'c' || o_custkey % 3 AS chrom, o_orderkey AS pos, 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'q10;low' WHEN o_orderkey % 4 = 1 THEN 'PASS' ELSE '' END AS filter,
  (row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1)::BIGINT AS ordinal FROM orders QUALIFY o_orderkey % 11 <> 5""")
def vcf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a folder of parts, numbered in file order; lines without all columns or with a bad position are skipped."""
    key = F.col("o_orderkey")
    filters = F.when(key % 4 == 0, "q10;low").when(key % 4 == 1, "PASS").otherwise(".")
    line = F.concat_ws("\t", F.concat(F.lit("c"), F.col("o_custkey") % 3), F.when(key % 22 == 5, "here").otherwise(key.cast("string")), F.concat(F.lit("o"), key), F.lit("A"), F.lit("AC"), F.lit("."), filters, F.lit("."))
    line = F.when(key % 22 == 16, "too\tshort").otherwise(line)
    path = _written(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", line.alias("line")), "vcf", "o_orderkey", "o_custkey")
    return text.read_vcf(spark, path).select("chrom", "pos", "id", F.array_join("filter", ";").alias("filter"), "ordinal")


@query("""
SELECT 'c' || l_suppkey % 5 AS chrom, l_orderkey AS start, l_partkey % 90 + 10 || 'M' || (40 + l_suppkey % 40) || 'I' || l_linenumber || 'S' AS cigar, (l_partkey % 60)::INT AS mapq,
  (l_orderkey % 4096)::INT AS flags, CASE WHEN l_returnflag = 'A' THEN l_partkey::VARCHAR END AS ps, CASE WHEN l_linestatus = 'F' THEN (l_linenumber % 3)::VARCHAR END AS hp FROM lineitem WHERE l_suppkey % 7 <> 3""")
def sam_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of SAM text; unplaced reads are left out."""
    cigar = F.concat(F.col("l_partkey") % 90 + 10, F.lit("M"), 40 + F.col("l_suppkey") % 40, F.lit("I"), F.col("l_linenumber"), F.lit("S"))
    chrom = F.when(F.col("l_suppkey") % 7 == 3, "*").otherwise(F.concat(F.lit("c"), F.col("l_suppkey") % 5))
    tags = [F.when(F.col("l_returnflag") == "A", F.concat(F.lit("PS:i:"), F.col("l_partkey"))), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("HP:i:"), F.col("l_linenumber") % 3))]
    line = F.concat_ws("\t", F.lit("r"), F.col("l_orderkey") % 4096, chrom, F.col("l_orderkey") + 1, F.col("l_partkey") % 60, cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("*"), F.lit("XX:Z:PS:i:1"), *tags)
    path = _written(table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line")), "sam", "l_orderkey")
    return text.read_sam(spark, path).drop("read_ord", "seq")


@query("""
SELECT 'n' || c_nationkey AS chrom, c_custkey AS start, c_custkey + 1 + c_nationkey AS "end", c_mktsegment || '|x' AS extra, (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS ordinal,
  CASE c_custkey % 3 WHEN 0 THEN 'Zero' WHEN 1 THEN 'Haploid' ELSE 'Unset' END AS ploidy FROM customer""")
def bed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their further columns, and the copy numbers of the same regions."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("\t", F.concat(F.lit("n"), "c_nationkey"), "c_custkey", F.col("c_custkey") + 1 + F.col("c_nationkey")).alias("bed"), "c_mktsegment")
    regions = text.read_bed(spark, _written(rows.select("c_custkey", F.concat_ws("\t", "bed", "c_mktsegment", F.lit("x")).alias("line")), "bed", "c_custkey"))
    copies = text.read_ploidy(spark, _written(rows.select("c_custkey", F.concat_ws("\t", "bed", F.col("c_custkey") % 3).alias("line")), "ploidy", "c_custkey"))
    return regions.withColumn("extra", F.array_join("extra", "|")).join(copies.select("chrom", "start", "ploidy"), ["chrom", "start"])


_GENOME = """g AS (SELECT s_suppkey, substr(string_agg(translate(md5(s_suppkey || '/' || i), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY i), 1, 320) AS seq FROM supplier, range(10) t(i) GROUP BY s_suppkey)"""


def _genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of 320 bases as FASTA of 50 bases a line, read back in pieces of 64."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _letters(F.col("s_suppkey"), 320).alias("seq"))
    parts = F.concat(F.array(F.concat(F.lit(">s"), "s_suppkey", F.lit(" of a supplier"))), F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.substring("seq", i * 50 + 1, F.lit(50))))
    return text.read_fasta(spark, _written(rows.select("s_suppkey", F.posexplode(parts).alias("i", "line")), "fasta", "s_suppkey", "i"), 64)


@query(f"WITH {_GENOME} SELECT 's' || s_suppkey AS chrom, i * 64 AS chunk_start, substr(seq, (i * 64 + 1)::INT, 64) AS seq FROM g, range(5) t(i)")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _genome(spark, sf_dir)


@query(f"""
WITH {_GENOME}, d AS (SELECT c_custkey, s_suppkey, c_custkey % 200 AS p, c_custkey % 200 + 50 + c_nationkey AS e FROM customer JOIN supplier ON s_suppkey = c_custkey // 15)
SELECT c_custkey AS read_ord, -(e - p) AS size, substr(seq, (p + 1)::INT, (e - p + 1)::INT) AS sequence FROM d JOIN g USING (s_suppkey)""")
def deletion_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference bases of deletions, over the borders of the reference's pieces."""
    c = table(spark, sf_dir, "customer")
    p = F.col("c_custkey") % 200
    size = 50 + F.col("c_nationkey").cast("bigint")
    v = F.array(F.struct(p.alias("position"), (p + size).alias("end"), F.lit("Del").alias("indel"), (-size).alias("size"), F.lit(None).cast("string").alias("sequence")))
    spanning = c.select(F.concat(F.lit("s"), F.floor(F.col("c_custkey") / 15)).alias("chrom"), F.lit(0).cast("bigint").alias("ne"), F.col("c_custkey").alias("read_ord"), F.lit(None).cast("bigint").alias("ps"), F.lit(None).cast("int").alias("hp"), v.alias("pileups"))
    got = haplotypes.fill_deletions(spanning, _genome(spark, sf_dir), 64)
    return got.select("read_ord", F.col("pileups")[0]["size"].alias("size"), F.col("pileups")[0]["sequence"].alias("sequence"))


@query("""
SELECT 'c' || l_suppkey % 5 AS chrom, l_orderkey AS start, l_orderkey + l_partkey % 90 + 10 + q AS "end", -q AS size, l_orderkey - 1 + l_partkey % 90 + 10 AS position
FROM (SELECT *, l_quantity::BIGINT + 40 AS q FROM lineitem) WHERE l_partkey % 60 >= 5 AND q BETWEEN 60 AND 80""")
def plup_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads to an index and back, as text and as Parquet: both are read, and what differs would be left out."""
    cigar = F.concat(F.col("l_partkey") % 90 + 10, F.lit("M"), F.col("l_quantity").cast("long") + 40, F.lit("D"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("c"), F.col("l_suppkey") % 5).alias("chrom"), F.col("l_orderkey").alias("start"), cigar.alias("cigar"), F.lit("ACGT").alias("seq"), (F.col("l_partkey") % 60).cast("int").alias("mapq"), F.lit(0).alias("flags"),
        F.lit(None).cast("string").alias("ps"), F.lit(None).cast("string").alias("hp"), F.monotonically_increasing_id().alias("read_ord"),
    )
    made, p = PileupParams(sizemin=50, sizemax=80), GenotypeParams(sizemin=60, sizemax=80)
    scratch, one, two = _folder(spark, "reads"), _folder(spark, "index"), _folder(spark, "index") + ".plup.parquet"
    pileup.reads_to_pileups(rows, made).write.parquet(scratch)  # both sinks look at them twice
    reads = spark.read.parquet(scratch)
    parts = max(4, -(-reads.count() // _PART))
    text.write_plup(reads, one, made, parts)
    text.write_index(reads, two, made, parts)
    flat = lambda df: df.select("chrom", "start", "end", F.explode_outer("pileups").alias("v")).where("v is not null").select("chrom", "start", "end", "v.size", "v.position")
    return flat(text.read_plup(spark, one, p)).intersectAll(flat(text.read_reads(spark, two, p)))
