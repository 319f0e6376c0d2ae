"""Sources and sinks: VCF, BED, FASTA index, FASTA, SAM text, pileup index (text and Parquet), ploidy."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pileup
from ..params import GenotypeParams, PileupParams
from .bam import read_bam

# The sample columns of the output, as (name, number, type, description).
FORMATS = (
    ("GT", "1", "String", "Genotype"),
    ("FT", "1", "Integer", "Filter bits"),
    ("SQ", "1", "Integer", "Phred scaled quality of a variant being in the sample"),
    ("GQ", "1", "Integer", "Phred scaled quality of the genotype"),
    ("PS", "1", "Integer", "Phase set"),
    ("NE", "1", "Integer", "Neighbourhood"),
    ("DP", "1", "Integer", "Coverage"),
    ("AD", "R", "Integer", "Coverage of the alleles"),
    ("KS", ".", "Integer", "Path scores"),
)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, row) of text lines: file, split of the file and running number tell their order. Spark deals
    splits to tasks by size, so that the running number alone does not."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, ordinal): lines numbered in order of files and of lines in them. The splits are counted first; their
    table has a row a split, whatever their size."""
    lines = _placed(spark, path)
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.min("row").alias("__first"), F.count("*").alias("__n"))
    splits = splits.select("file", "block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return lines.join(splits, ["file", "block"]).select("value", (F.col("__before") + F.col("row") - F.col("__first")).alias("ordinal"))


def _ordered(spark: SparkSession, path: str) -> DataFrame:
    """(value, ordinal) without a second look at the files: ordinal is a text that sorts in their order."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")).distinct()  # names only
    files = files.select("file", F.row_number().over(Window.orderBy("file")).alias("__k"))
    return _placed(spark, path).join(F.broadcast(files), "file").select("value", F.format_string("%06x.%012x.%016x", "__k", "block", "row").alias("ordinal"))


def head_lines(spark: SparkSession, path: str, mark: str = "#") -> list[str]:
    """The lines at the head of a file (of a folder: its first) that start with mark; nothing after them is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = jvm.org.apache.hadoop.fs.Path(path)
    system = name.getFileSystem(conf)
    if system.getFileStatus(name).isDirectory():
        parts = sorted(str(f.getPath()) for f in system.listStatus(name) if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")))
        if not parts:
            return []
        name = jvm.org.apache.hadoop.fs.Path(parts[0])
    stream = system.open(name)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(name)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        out = []
        while (line := reader.readLine()) is not None and line.startswith(mark):
            out.append(line)
        return out
    finally:
        stream.close()


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info, ordinal); malformed lines are skipped."""
    lines = _numbered(spark, path).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    rows = lines.select(f.alias("f"), "ordinal").where(F.size("f") >= 8)
    filters = F.when(F.get("f", F.lit(6)) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get("f", F.lit(6)), ";"))
    rows = rows.select(
        F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("bigint").alias("pos"), F.get("f", F.lit(2)).alias("id"), F.get("f", F.lit(3)).alias("ref"),
        F.get("f", F.lit(4)).alias("alt"), F.get("f", F.lit(5)).alias("qual"), filters.alias("filter"), F.get("f", F.lit(7)).alias("info"), "ordinal",
    )
    return rows.where(F.col("pos").isNotNull() & F.col("ref").rlike("^[A-Za-z]+$"))


def read_vcf_header(spark: SparkSession, path: str) -> list[str]:
    """Header lines in order; nothing after them is read."""
    return head_lines(spark, path)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) of a VCF header or a FASTA index (.fai)."""
    if path.endswith(".fai"):
        f = F.split("value", "\t")
        return spark.read.text(path).where("value <> ''").select(f[0].alias("chrom"), F.get(f, F.lit(1)).try_cast("bigint").alias("length"))
    text = spark.createDataFrame([(x,) for x in head_lines(spark, path) if x.startswith("##contig=<")], "value string")
    length = F.regexp_extract("value", "length=([0-9]+)", 1)
    return text.select(F.regexp_extract("value", "ID=([^,>]+)", 1).alias("chrom"), F.when(length != "", length).cast("bigint").alias("length"))


def _checked_bed(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    rows = _numbered(spark, path).where("value <> ''").select(f.alias("f"), "value", "ordinal")
    start, end = F.get("f", F.lit(1)).try_cast("bigint"), F.get("f", F.lit(2)).try_cast("bigint")
    bad = (F.size("f") < 3) | start.isNull() | end.isNull() | (end <= start)
    fail = F.raise_error(F.concat(F.lit("bad BED line: "), F.col("value")))
    return rows.select(F.when(bad, fail).otherwise(F.get("f", F.lit(0))).alias("chrom"), start.alias("start"), end.alias("end"), F.slice("f", 4, 1000).alias("extra"), "ordinal")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, extra, ordinal); a line of fewer than three columns or with end <= start is an error."""
    return _checked_bed(spark, path)


def ploidy_name(text: Column) -> Column:
    return F.when(F.trim(text) == "0", "Zero").when(F.trim(text) == "1", "Haploid").otherwise("Unset")


def read_ploidy(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, ploidy, ordinal); a missing fourth column is an error."""
    rows = _checked_bed(spark, path)
    missing = F.raise_error(F.concat(F.lit("no ploidy for "), F.col("chrom")))
    return rows.select("chrom", "start", "end", F.when(F.size("extra") < 1, missing).otherwise(ploidy_name(F.get("extra", F.lit(0)))).alias("ploidy"), "ordinal")


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """(chrom, chunk_start, seq) pieces of chunk bases; the last of a contig may be shorter.

    Every line's place follows from running lengths within its split and what the splits before it (of its file, and of
    the files before it in a folder) leave over, one row a split; lines are cut at chunk borders and joined by chunk. Nothing holds a contig.
    """
    lines = _placed(spark, path).withColumn("value", F.rtrim("value")).where("value <> ''")
    inside = Window.partitionBy("file", "block").orderBy("row")
    so_far, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("value").startswith(">")
    lines = lines.withColumns({"name": F.when(head, F.regexp_extract("value", "^>(\\S*)", 1)), "n": F.when(head, 0).otherwise(F.length("value"))})
    lines = lines.withColumns({"own": F.last("name", ignorenulls=True).over(so_far), "headers": F.count("name").over(so_far), "run": F.coalesce(F.sum("n").over(before), F.lit(0))})
    lines = lines.withColumn("base", F.max(F.when(head, F.col("run"))).over(so_far))  # bases of the split ahead of the last header
    splits = lines.groupBy("file", "block").agg(F.max_by("own", "row").alias("last"), (F.sum("n") - F.coalesce(F.max("base"), F.lit(0))).alias("tail"), (F.max("headers") > 0).alias("has"))
    past = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # bases since the last header ahead of the split: the tail of the split that has it, and the whole splits between
    splits = splits.withColumn("split", F.struct("file", "block"))
    splits = splits.withColumns({"carried": F.last("last", ignorenulls=True).over(past), "tails": F.coalesce(F.sum("tail").over(past), F.lit(0)), "upto": F.last(F.when(F.col("has"), F.col("split")), ignorenulls=True).over(past)})
    whole = splits.select(F.col("split").alias("upto"), F.col("tails").alias("ahead"))
    splits = splits.join(whole, "upto", "left").select("file", "block", "carried", (F.col("tails") - F.coalesce("ahead", F.lit(0))).alias("offset"))
    rows = lines.where(~head).join(splits, ["file", "block"])
    at = F.when(F.col("own").isNull(), F.col("offset") + F.col("run")).otherwise(F.col("run") - F.col("base"))
    rows = rows.select(F.coalesce("own", "carried").alias("chrom"), at.cast("bigint").alias("at"), F.col("value").alias("s"))

    def cut(batches):
        """Lines that cross a chunk border, piece by piece."""
        import pyarrow as pa

        for batch in batches:
            out = []
            for chrom, place, seq in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lo = 0
                while lo < len(seq):
                    hi = min(len(seq), lo + chunk - (place + lo) % chunk)
                    out.append((chrom, place + lo, seq[lo:hi]))
                    lo = hi
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["chrom", "at", "s"])

    crosses = F.floor(F.col("at") / chunk) != F.floor((F.col("at") + F.length("s") - 1) / chunk)
    pieces = rows.where(~crosses).unionByName(rows.where(crosses).mapInArrow(cut, "chrom string, at bigint, s string"))
    pieces = pieces.withColumn("chunk_start", F.floor(F.col("at") / chunk) * chunk)
    joined = pieces.groupBy("chrom", "chunk_start").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("ps"))
    return joined.select("chrom", "chunk_start", F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("seq"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, cigar, seq, mapq, flags, ps, hp, read_ord) of SAM text; unplaced reads are left out."""
    f = F.split("value", "\t")
    rows = _ordered(spark, path).where(~F.col("value").startswith("@")).select(f.alias("f"), "ordinal").where(F.size("f") >= 11)
    tag = lambda name: F.nullif(F.regexp_extract(F.array_join(F.slice("f", 12, 10_000), "\t"), f"(?:^|\t){name}:i:(-?[0-9]+)", 1), F.lit(""))
    seq = F.when(F.get("f", F.lit(9)) == "*", "").otherwise(F.get("f", F.lit(9)))
    return rows.where(F.get("f", F.lit(2)) != "*").select(
        F.get("f", F.lit(2)).alias("chrom"), (F.get("f", F.lit(3)).try_cast("bigint") - 1).alias("start"), F.get("f", F.lit(5)).alias("cigar"), seq.alias("seq"),
        F.get("f", F.lit(4)).try_cast("int").alias("mapq"), F.get("f", F.lit(1)).try_cast("int").alias("flags"), tag("PS").alias("ps"), tag("HP").alias("hp"), F.col("ordinal").alias("read_ord"),
    )


def read_plup(spark: SparkSession, path: str, p: GenotypeParams) -> DataFrame:
    """Reads of a pileup index (plain or gzip text); its parameters are compared with p, with warnings."""
    lines = _ordered(spark, path).withColumnRenamed("ordinal", "read_ord")
    head = head_lines(spark, path, "# ")[:1]
    if head:
        try:
            p.index_mismatches(json.loads(head[0][2:]))
        except ValueError:
            pass  # an unreadable header only loses the comparison
    return pileup.decode_reads(lines, p.sizemin, p.sizemax)


def read_alignments(spark: SparkSession, path: str, chunk_mbp: int = 25) -> DataFrame:
    """Reads with CIGARs, by the file's kind: BAM, SAM text, or a Parquet table."""
    if path.endswith(".bam"):
        return read_bam(spark, path, chunk_mbp)
    if path.endswith((".sam", ".sam.gz")):
        return read_sam(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported reads: {path}")


def read_reads(spark: SparkSession, path: str, p: GenotypeParams) -> DataFrame:
    """Reads with pileups, by the file's kind: a .plup, .plup.gz or .plup.parquet index, or alignments."""
    if path.endswith((".plup", ".plup.gz")):
        return read_plup(spark, path, p)
    if path.endswith(".plup.parquet"):
        return read_index(spark, path, p)
    return pileup.reads_to_pileups(read_alignments(spark, path), p)


def _by_place(reads: DataFrame, parts: int | None) -> DataFrame:
    """reads in parts by place (of no number: the session's), each sorted. Spark works reads out twice for that, once for the borders."""
    return reads.repartitionByRange(*([parts] if parts else []), "chrom", "start").sortWithinPartitions("chrom", "start")


def write_index(reads: DataFrame, path: str, p: PileupParams, parts: int | None = None) -> None:
    """The reads of a pileup index as Parquet, a folder a contig, sorted by start: scans skip other contigs and places."""
    kept = _by_place(reads, parts).withColumns({"contig": F.col("chrom"), "made_with": F.lit(json.dumps(asdict(p)))})
    kept.write.mode("overwrite").partitionBy("contig").parquet(path)


def read_index(spark: SparkSession, path: str, p: GenotypeParams) -> DataFrame:
    """Reads of a Parquet index; its parameters are compared with p, with warnings, and sizes out of bounds dropped."""
    rows = spark.read.parquet(path)
    for r in rows.select("made_with").limit(1).collect():
        p.index_mismatches(json.loads(r.made_with))
    fits = F.filter("pileups", lambda v: F.abs(v["size"]).between(p.sizemin, p.sizemax))
    return rows.withColumn("pileups", fits).drop("made_with")


def write_plup(reads: DataFrame, path: str, p: PileupParams, parts: int | None = None) -> None:
    """One `# {params}` line in a part of its own, then the reads sorted by place."""
    spark = reads.sparkSession
    lines = pileup.encode_reads(_by_place(reads, parts)).select("line")
    spark.createDataFrame([("# " + json.dumps(asdict(p)),)], "line string").coalesce(1).write.mode("overwrite").text(path)
    lines.write.mode("append").text(path)


def vcf_lines(genotypes: DataFrame) -> DataFrame:
    """(line, chrom, pos) of genotyped records."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    many = lambda c: F.when(F.size(c) == 0, ".").otherwise(F.array_join(F.transform(F.col(c), lambda x: F.coalesce(x.cast("string"), F.lit("."))), ","))
    filters = F.when(F.size("filter") == 0, ".").otherwise(F.array_join("filter", ";"))
    sample = F.concat_ws(":", "gt", text("ft"), text("sq"), text("gq"), text("ps"), text("ne"), text("dp"), many("ad"), many("ks"))
    line = F.concat_ws("\t", "chrom", text("pos"), text("id"), "ref", "alt", text("qual"), filters, text("info"), F.lit(":".join(f[0] for f in FORMATS)), sample)
    return genotypes.select(line.alias("line"), "chrom", "pos")


def vcf_header(header: list[str], sample: str | None) -> list[str]:
    """Input header with the sample columns replaced; the sample is the given one, else the first named."""
    column = next((h.split("\t") for h in header if h.startswith("#CHROM")), [])
    name = sample or (column[9] if len(column) > 9 else None)
    if name is None:
        raise ValueError("no sample in the VCF header; name one")
    meta = [h for h in header if h.startswith("##") and not h.startswith("##FORMAT=")]
    formats = [f'##FORMAT=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in FORMATS]
    return [*meta, *formats, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", name])]


def _write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A small text file on any file system."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = name.getFileSystem(spark._jsc.hadoopConfiguration()).create(name, True)
    try:
        out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
    finally:
        out.close()


def write_vcf(genotypes: DataFrame, path: str, header: list[str], sample: str | None = None) -> None:
    """A folder of text parts, the header's first by name; records are not sorted. A path that ends in .vcf becomes one file,
    put together from the parts."""
    from ..functions.sequences import plain_bases

    spark, folder = genotypes.sparkSession, path + ".parts" if path.endswith(".vcf") else path
    strict = genotypes.withColumn("ref", F.when(F.col("ref").rlike("^[ACGTNacgtn]+$"), F.col("ref")).otherwise(plain_bases(F.col("ref"))))
    vcf_lines(strict).select("line").write.mode("overwrite").text(folder)
    _write_lines(spark, f"{folder}/header.vcf", vcf_header(header, sample))
    if folder == path:
        return
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    whole, parts = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(folder)
    system = whole.getFileSystem(conf)
    out = system.create(whole, True)
    try:
        for part in sorted((f.getPath() for f in system.listStatus(parts)), key=lambda f: (f.getName() != "header.vcf", f.getName())):
            if part.getName().startswith(("part-", "header")):
                stream = system.open(part)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                stream.close()
    finally:
        out.close()
    system.delete(parts, True)
