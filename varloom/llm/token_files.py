"""Flat unsigned integer token files with 64-bit offsets.

Documents are range-partitioned and sorted by id (null first; ties by text). Every partition writes
`shard-NNNNN.<task>.bin` (token ids, little-endian uint16 or uint32 by vocabulary size) and `.idx` (int64: format,
bytes per id, documents, then offsets[n+1], document ids[n], null flags[n]). Partition bases are prefix
sums of the partitions' token counts and stand in the manifest; a document's global start is base plus
offset. A retried task writes files of its own; only those of the attempt that Spark kept are listed.
Readers memory-map local files and open any other store through pyarrow.

Defined cases: a null or empty text is the end id alone; repeated rows are written each; an empty table
gives an empty manifest and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from urllib.parse import urlparse

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks

MAGIC = 0x5641524C
#: A space beside white space or at an end of the text: there a split at the space could change the pre-tokens.
_ODD = re.compile(r"\s |[ ]\s|^ | $")
_SAFE_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_CACHE_WORDS, _CACHE_CHARS, _AT_ONCE = 600_000, 8_000_000, 1 << 16


class _Codes(dict):
    """Numbers keys as they come; `fresh` holds those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        n = self[key] = len(self) + 1
        self.fresh.append(key)
        return n


class WordEncoder:
    """The library's ids of whole texts, each distinct word encoded once.

    Byte-level BPE pre-tokenises so that a single space between two other characters always opens a
    pre-token; text is therefore encoded word by word (with its space) without changing any id.
    """

    def __init__(self, file: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.end_id = Tokenizer.from_file(file), end_id
        vocab = self.tok.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id: byte-level pieces have a character a byte
        for piece, i in vocab.items():
            self.width[i] = len(piece)
        self._reset()

    def _reset(self) -> None:
        self.codes, self.chars = _Codes(), 0
        self.flat, self.at = np.array([self.end_id], np.uint32), np.array([0, 1], np.int64)  # code 0: the end

    def _learn(self) -> None:
        """Ids of the fresh words. Words without white space at an end are encoded many in one string, since
        the space before each opens a pre-token, and cut apart by the byte lengths of their ids."""
        fresh, self.codes.fresh = self.codes.fresh, []
        if not fresh:
            return
        self.chars += sum(map(len, fresh))
        alone = [n for n, k in enumerate(fresh) if isinstance(k, tuple) or not k or k[0].isspace() or k[-1].isspace()]
        single = set(alone)
        joint = [n for n in range(len(fresh)) if n not in single] if alone else range(len(fresh))
        words = [" " + fresh[n] for n in joint]
        lens = np.zeros(len(fresh), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(words), _AT_ONCE):
            some = words[i : i + _AT_ONCE]
            strings = ["".join(some[k : k + 256]) for k in range(0, len(some), 256)]
            ids = self._ids(strings)
            done = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(w.encode()) for w in some])) + 1
            parts.append((ids, np.diff(done, prepend=0)))
        if alone:
            got = [e.ids for e in self.tok.encode_batch_fast([k[0] if isinstance(k, tuple) else " " + k for k in (fresh[n] for n in alone)], add_special_tokens=False)]
            parts.append((np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)))
        order = np.array([*joint, *alone], np.int64)
        flat, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        lens[order] = size
        start = np.zeros(len(fresh), np.int64)
        start[order] = np.cumsum(size) - size
        ends = np.cumsum(lens)
        place = np.arange(int(ends[-1])) + np.repeat(start - (ends - lens), lens)
        self.at = np.concatenate([self.at, self.at[-1] + ends])
        self.flat = np.concatenate([self.flat, flat[place].astype(np.uint32)])

    def _ids(self, strings: list[str]) -> np.ndarray:
        got = self.tok.encode_batch_fast(strings, add_special_tokens=False)
        return np.concatenate([np.array(e.ids, np.uint32) for e in got])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and the number of ids of each text."""
        if len(self.codes) > _CACHE_WORDS or self.chars > _CACHE_CHARS:
            self._reset()
        code, codes, counts = self.codes.__getitem__, [], []
        for text in texts:
            before = len(codes)
            if text:
                words = _SAFE_SPLIT.split(text) if _ODD.search(text) else text.split(" ")
                codes.append(code((words[0],)))
                codes.extend(map(code, words[1:]))
            codes.append(0)
            counts.append(len(codes) - before)
        self._learn()
        ids, lens = gather(self.flat, self.at, np.array(codes, np.int64))
        ends = np.cumsum(np.array(counts, np.int64)) if counts else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(lens)])
        return ids, np.diff(np.concatenate([[0], total[ends]]))


def gather(flat: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[at[c]:at[c+1]] of all codes one after another, and their lengths."""
    lens = at[codes + 1] - at[codes]
    ends = np.cumsum(lens)
    n = int(ends[-1]) if len(ends) else 0
    index = np.arange(n, dtype=np.int64)
    index += np.repeat(at[codes] - (ends - lens), lens)
    return flat[index], lens


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder_of(file: str, end_id: int) -> WordEncoder:
    """One encoder a Python worker, so that later tasks find words known."""
    if (file, end_id) not in _encoders:
        _encoders[file, end_id] = WordEncoder(file, end_id)
    return _encoders[file, end_id]


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, key: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Writes the files and manifest.json under path (a URI all executors share); returns the manifest rows."""
    from tokenizers import Tokenizer

    vocab = max(Tokenizer.from_file(tokenizer_file).get_vocab().values(), default=0)
    dtype = "<u2" if max(vocab, end_id) < 1 << 16 else "<u4"
    spark = docs.sparkSession
    _open_fs(path)[0].create_dir(_open_fs(path)[1], recursive=True)

    def write(batches):
        import pyarrow as pa

        ctx = TaskContext.get()
        name = f"shard-{ctx.partitionId():06d}.{ctx.taskAttemptId()}"
        store, root = _open_fs(path)
        counts, keys, nulls, data = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder_of(tokenizer_file, end_id)
            data = data or store.open_output_stream(f"{root}/{name}.bin")
            texts = batch.column(1)
            step = max(1, int(batch.num_rows * block_bytes / max(1, texts.nbytes)))
            for i in range(0, batch.num_rows, step):
                ids, n = encoder.encode([x or "" for x in texts.slice(i, step).to_pylist()])
                data.write(ids.astype(dtype).tobytes())
                counts.append(n)
            ids_col = batch.column(0)
            nulls.append(np.asarray(ids_col.is_null().to_numpy(zero_copy_only=False), np.int64))
            keys.append(ids_col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        if data is None:
            return
        data.close()
        lens = np.concatenate(counts)
        offsets = np.concatenate([[0], np.cumsum(lens)])
        head = np.array([MAGIC, np.dtype(dtype).itemsize, len(lens)])
        with store.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.concatenate([head, offsets, *keys, *nulls]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [ctx.partitionId()], "file": [name], "n_docs": [len(lens)], "n_tokens": [int(offsets[-1])]})

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    done = rows.mapInArrow(write, "part long, file string, n_docs long, n_tokens long").collect()  # one row a partition
    base, manifest = 0, []
    for r in sorted(done):
        manifest.append((r.part, r.file, r.n_docs, r.n_tokens, base))
        base += r.n_tokens
    store, root = _open_fs(path)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "end_id": end_id, "tokens": base, "shards": [dict(zip(("part", "file", "n_docs", "n_tokens", "base"), m, strict=True)) for m in manifest]}).encode())
    return spark.createDataFrame(manifest, "part long, file string, n_docs long, n_tokens long, base long")


class TokenShard:
    """One shard, memory-mapped where the store is local."""

    def __init__(self, path: str, name: str):
        if urlparse(path).scheme in ("", "file"):
            local = urlparse(path).path
            self._raw = np.memmap(f"{local}/{name}.idx", "<i8", "r")
        else:
            store, root = _open_fs(path)
            self._raw = np.frombuffer(store.open_input_stream(f"{root}/{name}.idx").read(), "<i8")
        magic, width, n = map(int, self._raw[:3])
        if magic != MAGIC:
            raise ValueError(f"{name}.idx is no token index")
        self.n = n
        self.offsets = self._raw[3 : 4 + n]
        self.keys = self._raw[4 + n : 4 + 2 * n]
        self.nulls = self._raw[4 + 2 * n : 4 + 3 * n]
        self.dtype = np.dtype(f"<u{width}")
        if urlparse(path).scheme in ("", "file"):
            self._ids = np.memmap(f"{urlparse(path).path}/{name}.bin", self.dtype, "r")
        else:
            self._ids, self._file = None, _open_fs(path)[0].open_input_file(f"{_open_fs(path)[1]}/{name}.bin")

    def ids(self, first: int, last: int) -> np.ndarray:
        """Token ids first to last-1 of the shard."""
        if self._ids is not None:
            return self._ids[first:last]
        width = self.dtype.itemsize
        self._file.seek(first * width)
        return np.frombuffer(self._file.read((last - first) * width), self.dtype)


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; one task a shard."""
    n = max(1, manifest.count())

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                shard = TokenShard(path, r["file"])
                off = np.asarray(shard.offsets)
                for i, j in blocks(off, 4 << 20):
                    ids = np.asarray(shard.ids(int(off[i]), int(off[j]))).astype("<u4")
                    cut = off[i : j + 1] - off[i]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(shard.keys[i:j]), mask=np.asarray(shard.nulls[i:j]) > 0),
                            pa.array(off[i:j] + r["base"]), pa.array(np.diff(cut)), pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.repartitionByRange(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
