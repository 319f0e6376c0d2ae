import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from varloom.operators import haplotypes, pileup
from varloom.params import GenotypeParams, PileupParams
from varloom.sources import bam, text

CONTIGS = [("one", 300_000), ("two", 90_000)]


def bgzf(data):
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    size = 12 + 6 + len(packed) + 8 - 1
    return struct.pack("<4BI2BH", 31, 139, 8, 4, 0, 0, 255, 6) + b"BC" + struct.pack("<HH", 2, size) + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(contig, start, mapq, flags, ops, seq, tags):
    cigar = b"".join(struct.pack("<I", n << 4 | bam._OPS.index(op)) for n, op in ops)
    codes = [bam._BASES.index(c.encode()) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    raw = struct.pack("<iiBBHHHiiii", contig, start, 2, mapq, 0, len(ops), flags, len(seq), -1, -1, 0) + b"r\0" + cigar + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(raw)) + raw


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = random.Random(7)
    folder = tmp_path_factory.mktemp("bam")
    reads = sorted((rng.choice([0, 0, 1]), rng.randrange(80_000), rng.randrange(60), rng.choice([0, 16, 1024])) for _ in range(900))
    stream = b"BAM\1" + struct.pack("<i", 5) + b"@HD\n\0" + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in CONTIGS)
    starts, sam = [], ["@HD\tVN:1.6"]
    for k, (contig, start, mapq, flags) in enumerate([*reads, (-1, -1, 0, 4)]):
        ops = [(rng.randint(10, 99), "M"), (rng.randint(40, 80), rng.choice("ID")), (7, "="), (3, "X"), (5, "S")]
        seq = "".join(rng.choice("ACGTN") for _ in range(sum(n for n, op in ops if op in "MIS=X")))
        tags = b"NMC\3" + b"RGZgroup\0" + b"MLBC" + struct.pack("<i3B", 3, 1, 2, 3) + (b"HPC" + bytes([k % 3]) + b"PSi" + struct.pack("<i", k * 7) if k % 2 else b"XAAq") + b"XFf" + struct.pack("<f", 1.5)
        starts.append((len(stream), contig, start, sum(n for n, op in ops if op in "MD=X")))
        stream += record(contig, start, mapq, flags, ops, seq, tags)
        name = "*" if contig < 0 else CONTIGS[contig][0]
        sam.append(f"r\t{flags}\t{name}\t{start + 1}\t{mapq}\t{''.join(f'{n}{op}' for n, op in ops)}\t*\t0\t0\t{seq}\t*" + (f"\tPS:i:{k * 7}\tHP:i:{k % 3}" if k % 2 else ""))
    block, out, at = 700, b"", []
    for i in range(0, len(stream), block):
        at.append(len(out))
        out += bgzf(stream[i : i + block])
    out += bgzf(b"")
    index = b"BAI\1" + struct.pack("<i", 2)
    for contig in (0, 1):
        windows = {}
        for place, c, start, length in starts:
            if c == contig:
                for w in range(start >> 14, (start + length - 1 >> 14) + 1):
                    windows.setdefault(w, at[place // block] << 16 | place % block)
        n = max(windows) + 1
        index += struct.pack("<i", 1) + struct.pack("<Ii", 4681, 1) + struct.pack("<QQ", 0, 1) + struct.pack("<i", n) + b"".join(struct.pack("<Q", windows.get(w, 0)) for w in range(n))
    (folder / "plain.bam").write_bytes(out)
    (folder / "indexed.bam").write_bytes(out)
    (folder / "indexed.bam.bai").write_bytes(index)
    (folder / "reads.sam").write_text("\n".join(sam) + "\n")
    return folder


def rows(df):
    return [tuple(r)[:-1] for r in df.orderBy("read_ord").collect()]


@pytest.mark.parametrize("name", ["plain", "indexed"])
def test_bam_equals_sam_text(spark, files, name):
    want = rows(text.read_sam(spark, f"{files}/reads.sam"))
    got = bam.read_bam(spark, f"{files}/{name}.bam")
    assert len(want) == 900 and rows(got) == want
    if name == "indexed":
        reader = bam.BamReader({"path": f"{files}/{name}.bam", "chunk": "20000"})
        parts = reader.partitions()
        assert len(parts) > 6 and [x[:-1] for p in parts for x in reader.read(p)] == want


def test_reads_of_a_bam_file_make_pileups(spark, files):
    p = GenotypeParams(sizemin=40, kmer=4)
    one, other = (text.read_reads(spark, f"{files}/{x}", p) for x in ("indexed.bam", "reads.sam"))
    assert rows(one) == rows(other) and one.where("size(pileups) > 0").count() > 100


def test_broken_files_are_refused(spark, files, tmp_path):
    (tmp_path / "x.bam").write_bytes((files / "plain.bam").read_bytes()[:-500])
    with pytest.raises(Exception, match="record|block|stream"):
        bam.read_bam(spark, f"{tmp_path}/x.bam").count()
    (tmp_path / "y.bam").write_bytes(b"something else, not blocks")
    with pytest.raises(Exception, match="BGZF"):
        bam.read_bam(spark, f"{tmp_path}/y.bam").count()


def test_parquet_index_skips_other_places(spark, files, tmp_path):
    p = PileupParams(sizemin=40)
    reads = pileup.reads_to_pileups(text.read_sam(spark, f"{files}/reads.sam"), p)
    text.write_index(reads, f"{tmp_path}/i.plup.parquet", p)
    got = text.read_reads(spark, f"{tmp_path}/i.plup.parquet", GenotypeParams(sizemin=60))
    fits = F.filter("pileups", lambda v: F.abs(v["size"]).between(60, 10_000))
    assert rows(got.select(*reads.columns)) == rows(reads.withColumn("pileups", fits))
    hoods = spark.createDataFrame([("two", 30_000, 30_100), ("two", 31_000, 31_001)], "chrom string, start long, end long")
    few = haplotypes.near(got, hoods)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(contig" in plan and "PushedFilters: [IsNotNull(start)" in plan
    assert rows(few.select(*reads.columns)) == rows(got.select(*reads.columns).where("chrom = 'two' and start < 31001 and `end` > 30000"))
