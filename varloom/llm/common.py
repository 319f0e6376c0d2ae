"""Shared helpers: shared-folder tables, lambda-bound expressions and numpy text hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and tab to carriage return.
WS_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WS_REGEX = r"[\x20\x09-\x0D]+"
_made: list[tuple[SparkSession, str]] = []
_hooked = False


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where driver and executors are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="varloom-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        _forget_at_exit(spark, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/varloom-{tag}-{uuid.uuid4().hex[:12]}"
    _forget_at_exit(spark, path)
    return path


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    global _hooked
    _made.append((spark, path))
    if not _hooked:
        _hooked = True
        atexit.register(_forget)


def _forget() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may already be gone at interpreter exit
            return


def delete(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one run of an operator, deleted once nothing reads them any more."""

    def __init__(self):
        self._tables: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_path(df.sparkSession, tag)
        df.write.mode("overwrite").parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self._tables.append((out, path))
        return out

    def drop(self, keep: tuple[DataFrame, ...] = ()) -> None:
        """Deletes all tables but those to keep."""
        for table, path in self._tables:
            if not any(table is k for k in keep):
                delete(table.sparkSession, path)
        self._tables = [t for t in self._tables if any(t[0] is k for k in keep)]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Actions inside send at most n rows at once to Python, so that long texts make no huge batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Gives memory that numpy and Arrow have freed, and powers of long texts, back to the system; Python workers live on
    from stage to stage."""
    import pyarrow as pa

    global _pow, _inv
    if len(_pow) > _POWERS:
        _pow, _inv = _pow[:_POWERS].copy(), _inv[:_POWERS].copy()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the C library of Linux
        ctypes.CDLL(None).malloc_trim(0)


def lean(work):
    """A batch function that releases memory at the end of its partition."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def lean_group(work):
    """A function of two arguments, for grouped or cogrouped tables, that releases memory after each group."""

    def run(one, two):
        try:
            return work(one, two)
        finally:
            release()

    return run


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often (and in whatever lambda) it is used."""
    return F.transform(F.array(value), body)[0]


# --- numpy text hashing -----------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = 1 << 20  # powers that are kept
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)
_IS_WS = np.zeros(256, bool)
_IS_WS[list(WS_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, _POWERS)
        ones = np.full(size, _BASE)
        ones[0] = 1
        _pow = np.cumprod(ones)
        ones[1:] = _BASE_INV
        _inv = np.cumprod(ones)
    return _pow[:n], _inv[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fresh 64-bit finaliser of each element (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string column; a null counts as an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(offsets: np.ndarray, limit: int):
    """(first, last) document numbers of runs of documents of about limit bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The little-endian number of the eight bytes from each position, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", padded.data, 0, (1,)).copy()


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of the texts, and per text the number of words."""
    n_docs, size = len(offsets) - 1, len(data)
    if size == 0:
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    solid = ~_IS_WS[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:size]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:size]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(size)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    words = mix64((total[e] - total[s]) * inverse[s])
    return words, np.diff(np.searchsorted(s, offsets)).astype(np.int64)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, never across texts; a text of 1 to k-1 words is one shingle of all its words."""
    n = len(words)
    ends = np.cumsum(counts)
    first = ends - counts
    out = np.zeros(n, np.uint64)
    odd = np.uint64(0xD6E8FEB86659FD93)
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the end of the text
    for j in range(k):
        part = words[j:] if j else words
        live = left[: len(part)] > j
        out[: len(part)] = np.where(live, (out[: len(part)] + part) * odd, out[: len(part)])
    out = mix64(out)
    keep = left >= k
    short = (counts > 0) & (counts < k)
    keep[first[short]] = True
    return out[keep], np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
