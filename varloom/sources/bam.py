"""BAM files as a Spark data source: BGZF blocks and alignment records decoded in Python, with no library.

With an index (`<file>.bai`) a file is dealt out by contig and chunk of bases, each read once, by the chunk that
holds its start; without one a file is one partition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "chrom string, start bigint, cigar string, seq string, mapq int, flags int, ps string, hp string, read_ord string"
# Letters of CIGAR operations and of packed bases, sizes of integer tags.
_OPS, _BASES = "MIDNSHP=X", b"=ACMGRSVTWYHKDBN"
_TAG = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I", b"f": "<f", b"A": "<c"}
_HIGH, _LOW = bytes(_BASES[i >> 4] for i in range(256)), bytes(_BASES[i & 15] for i in range(256))
_WINDOW = 14  # bits of a window of the linear index


def _open(path: str):
    """(file object, size) on any file system Arrow knows; a plain path is local."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(name)


class Blocks:
    """Bytes of a BGZF file from a virtual offset on."""

    def __init__(self, file, offset: int = 0):
        self.file, self.next, self.data, self.at = file, offset >> 16, b"", 0
        self._more()
        self.at = offset & 0xFFFF

    def _more(self) -> bool:
        self.here, self.at = self.next, 0
        self.file.seek(self.here)
        head = self.file.read(12)
        if len(head) < 12:
            self.data = b""
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no BGZF block at byte {self.here}")
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
        place, size = 0, None
        while place < len(extra):
            kind, n = extra[place : place + 2], struct.unpack_from("<H", extra, place + 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", extra, place + 4)[0] + 1
            place += 4 + n
        if size is None:
            raise ValueError(f"no block size at byte {self.here}")
        body = self.file.read(size - 12 - len(extra))
        self.data, self.next = zlib.decompress(body[:-8], -15), self.here + size
        return True

    def tell(self) -> int:
        if self.at == len(self.data):
            return self.next << 16
        return self.here << 16 | self.at

    def read(self, n: int) -> bytes:
        """n bytes, or none at the end of the file."""
        out = b""
        while len(out) < n:
            if self.at == len(self.data):
                if not self._more():
                    if out:
                        raise ValueError("the file ends within a record")
                    return b""
                continue
            part = self.data[self.at : self.at + n - len(out)]
            self.at += len(part)
            out += part
        return out


def header(blocks: Blocks) -> list[tuple[str, int]]:
    """(contig, length) of a file that has just been opened."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


def _tags(raw: bytes) -> dict[bytes, str]:
    """PS and HP of a record, if they are integers."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind, at = raw[at : at + 2], raw[at + 2 : at + 3], at + 3
        if kind in _TAG:
            if name in (b"PS", b"HP") and kind not in b"fA":
                out[name] = str(struct.unpack_from(_TAG[kind], raw, at)[0])
            at += struct.calcsize(_TAG[kind])
        elif kind in (b"Z", b"H"):
            at = raw.index(b"\0", at) + 1
        elif kind == b"B":
            at += 5 + struct.calcsize(_TAG[raw[at : at + 1]]) * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            raise ValueError(f"unknown tag type {kind!r}")
    return out


def records(blocks: Blocks) -> Iterator[tuple[int, int, int, tuple]]:
    """(virtual offset, contig number, start, other columns) of each record."""
    while True:
        place = blocks.tell()
        size = blocks.read(4)
        if not size:
            return
        raw = blocks.read(struct.unpack("<i", size)[0])
        contig, start, n_name, mapq, _, n_ops, flags, n_seq = struct.unpack_from("<iiBBHHHi", raw)
        at = 32 + n_name
        ops = struct.unpack_from(f"<{n_ops}I", raw, at)
        at += 4 * n_ops
        packed = raw[at : at + (n_seq + 1) // 2]
        seq = bytearray(2 * len(packed))
        seq[::2], seq[1::2] = packed.translate(_HIGH), packed.translate(_LOW)
        tags = _tags(raw[at + len(packed) + n_seq :])
        cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in ops)
        yield place, contig, start, (cigar, seq[:n_seq].decode(), mapq, flags, tags.get(b"PS"), tags.get(b"HP"))


def linear_index(raw: bytes) -> list[list[int]]:
    """Virtual offsets of each contig's windows of 16,384 bases, from a .bai index; 0 where no read is."""
    if raw[:4] != b"BAI\1":
        raise ValueError("not a .bai index")
    (n,), at, out = struct.unpack_from("<i", raw, 4), 8, []
    for _ in range(n):
        (bins,), at = struct.unpack_from("<i", raw, at), at + 4
        for _ in range(bins):
            at += 8 + 16 * struct.unpack_from("<i", raw, at + 4)[0]
        (size,), at = struct.unpack_from("<i", raw, at), at + 4
        out.append(list(struct.unpack_from(f"<{size}Q", raw, at)))
        at += 8 * size
    return out


@dataclass
class Part(InputPartition):
    """Reads of a file whose start on a contig is in [low, high); of all contigs if there is none."""

    file: int
    path: str
    offset: int = 0
    contig: int = -1
    low: int = 0
    high: int = 0


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.chunk = max(1, int(options.get("chunk", 25_000_000)) >> _WINDOW) << _WINDOW

    def partitions(self) -> list[Part]:
        out = []
        for k, path in enumerate(self.paths):
            try:
                with _open(path + ".bai") as f:
                    index = linear_index(f.read())
            except FileNotFoundError:
                out.append(Part(k, path))
                continue
            step = self.chunk >> _WINDOW
            for contig, windows in enumerate(index):
                for w in range(0, len(windows), step):
                    used = [x for x in windows[w : w + step] if x]
                    if used:
                        out.append(Part(k, path, used[0], contig, w << _WINDOW, w + step << _WINDOW))
        return out

    def read(self, part: Part):
        with _open(part.path) as f:
            first = Blocks(f)
            names = [name for name, _ in header(first)]
            found = records(first if part.contig < 0 else Blocks(f, part.offset))
            for place, contig, start, rest in found:
                if part.contig >= 0 and (contig != part.contig or start >= part.high):
                    return
                if contig >= 0 and (part.contig < 0 or start >= part.low):
                    yield (names[contig], start, *rest, f"{part.file:06x}.{place:016x}")


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str, chunk_mbp: int = 25) -> DataFrame:
    """(chrom, start, cigar, seq, mapq, flags, ps, hp, read_ord) of one or more files, by commas; unplaced reads are
    left out. An indexed file is dealt out by chunks of chunk_mbp million bases."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("chunk", chunk_mbp * 1_000_000).load(path)
