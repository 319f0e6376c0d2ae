"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m bytes with e edits or fewer shares at least m - q + 1 - q * e of its q-grams with the region it
stands in, all on diagonals (text position minus item position) within e of each other. Shared q-grams
are counted in cells of e + 1 diagonals; a band is two neighbouring cells, so bands overlap by half and
one of them holds all of a region's diagonals. Bands that meet the bound are verified by an alignment that
follows the band only, free at both ends of the text. e is a tenth of the item, less for items too short for
that many edits to leave a q-gram.

Texts and items are compared with A-Z lower-cased and white space as blanks, over whole texts.

The distinct items are broadcast in parts of about `part_bytes` at most; a larger benchmark takes several scans of
the documents, each against one part, which write nothing but hits. A benchmark's grams are dense in any text of
its language, so that sending all shared grams to a join would move far more than the scans read.

Defined cases: null or empty texts hold no item; null or empty items match nothing; items shorter than q
are found as exact substrings; repeated items are reported each, repeated rows judged each; null ids stay
null; empty tables give an empty result, or no matches; other columns are ignored by `find_leaks` and pass
through `drop_leaks`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, eight_bytes, lean, text_buffers

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_OUTSIDE = np.uint8(255)  # in no UTF-8 text


@dataclass(frozen=True)
class LeakParams:
    q: int = 8
    edit_share: float = 0.1
    part_bytes: int = 4 << 20
    block_bytes: int = 2 << 20


class Items:
    """The q-gram index of some items."""

    def __init__(self, ids: list, texts: list[str], p: LeakParams):
        self.q, self.ids = p.q, ids
        self.texts = [_FOLD[np.frombuffer(t.encode(), np.uint8)] for t in texts]
        self.m = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.maximum(np.minimum((self.m * p.edit_share).astype(np.int64), (self.m - p.q) // p.q), 0)
        self.need = self.m - p.q + 1 - p.q * self.edits
        self.short = [k for k in range(len(texts)) if self.m[k] < p.q]
        grams = [eight_bytes(t)[: max(0, len(t) - p.q + 1)] & self._mask() for t in self.texts]
        code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.code, first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.first, self.item, self.place = first, item[order], place[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._look(self.code)] = True

    def _mask(self) -> np.uint64:
        return np.uint64((1 << 8 * self.q) - 1)

    @staticmethod
    def _look(code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def hits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, position in it, item, position in the item) of every shared q-gram."""
        code = eight_bytes(data) & self._mask()
        at = np.flatnonzero(self.maybe[self._look(code)])
        slot = np.minimum(np.searchsorted(self.code, code[at]), max(len(self.code) - 1, 0))
        good = self.code[slot] == code[at] if len(self.code) else np.zeros(len(at), bool)
        at, slot = at[good], slot[good]
        doc = np.searchsorted(off, at, side="right") - 1
        good = at + self.q <= off[doc + 1]  # a q-gram over a text's end is none
        at, slot, doc = at[good], slot[good], doc[good]
        n = self.count[slot]
        ends = np.cumsum(n)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[slot] - (ends - n), n)
        return np.repeat(doc, n), np.repeat(at - off[doc], n), self.item[index], self.place[index]

    def bands(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first diagonal) of the bands with enough shared q-grams."""
        doc, i, item, j = self.hits(data, off)
        width = self.edits[item] + 1
        cell = (i - j + self.m[item]) // width  # diagonals start at -m
        # as many bits as this part's items and this block's cells take; the last cell stays free, so that a band ends there
        item_bits, cell_bits = len(self.m).bit_length(), int(cell.max(initial=0) + 1).bit_length()
        if int(doc.max(initial=0)).bit_length() + item_bits + cell_bits > 63:
            raise OverflowError(f"{len(self.m)} items and {len(off) - 1} documents do not fit a band key")
        key = np.sort((doc << item_bits | item) << cell_bits | cell)
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        cells, n = key[head], np.diff(np.append(head, len(key)))
        # the band of a cell and the next one; a lone second cell is also the band that starts before it
        after = np.zeros(len(cells), np.int64)
        if len(cells) > 1:
            after[:-1] = np.where(cells[1:] == cells[:-1] + 1, n[1:], 0)
        it = cells >> cell_bits & (1 << item_bits) - 1
        ok = n + after >= self.need[it]
        cells, it = cells[ok], it[ok]
        first = (cells & (1 << cell_bits) - 1) * (self.edits[it] + 1) - self.m[it]
        return cells >> cell_bits + item_bits, it, first

    def align(self, item: int, data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end in the text) of the item's best place in each text data[begin:end] within a band.

        Cell (j, c): the item's first j bytes against text that ends at diagonal `first - e + c`.
        """
        pattern, e = self.texts[item], int(self.edits[item])
        m, width = len(pattern), 2 * (e + 1) + 2 * e
        start = first - e
        place = begin[:, None] + start[:, None] + np.arange(m + width)[None, :]
        inside = (place >= begin[:, None]) & (place < end[:, None])
        text = np.where(inside, data[np.clip(place, 0, max(len(data) - 1, 0))], _OUTSIDE)
        slope = np.arange(width + 1, dtype=np.int32)
        cost = np.zeros((len(begin), width + 1), np.int32)
        far = np.int32(1 << 20)
        for j in range(1, m + 1):
            new = cost + 1
            new[:, :width] -= text[:, j - 1 : j - 1 + width] == pattern[j - 1]
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            new[:, -1] = np.minimum(new[:, -1], far)
            cost = np.minimum.accumulate(new - slope, axis=1) + slope
        # text outside cannot be matched, only skipped at an edit each, so the best end lies inside
        best = cost.argmin(axis=1)
        return cost[np.arange(len(begin)), best], np.minimum(start + m + best, end - begin)

    def leaks(self, data: np.ndarray, off: np.ndarray, piece: int = 4 << 20) -> list[tuple[int, int, int, int]]:
        """(document, item, edits, end) of verified regions, the best of overlapping bands.

        A text longer than `piece` is read in pieces that overlap by the longest region, so no text needs more memory."""
        data = _FOLD[data]
        found: dict[tuple[int, int, int], int] = {}
        lap = int((self.m + self.edits).max(initial=0)) + self.q
        small = np.diff(off) <= piece + lap
        run = np.flatnonzero(np.append(True, small[1:] & small[:-1] == 0)) if len(small) else np.zeros(0, np.int64)
        for a, b in zip(run.tolist(), [*run[1:].tolist(), len(small)], strict=False):
            if small[a]:
                self._search(data[off[a] : off[b]], off[a : b + 1] - off[a], a, 0, found)
            else:
                for lo in range(0, int(off[b] - off[a]) - lap, piece):
                    part = data[off[a] + lo : min(off[a] + lo + piece + lap, off[b])]
                    self._search(part, np.array([0, len(part)]), a, lo, found)
        return sorted((d, k, x, y) for (d, k, y), x in found.items())

    def _search(self, data: np.ndarray, off: np.ndarray, first_doc: int, shift: int, found: dict[tuple[int, int, int], int]) -> None:
        doc, item, first = self.bands(data, off)
        order = np.argsort(item, kind="stable")
        doc, item, first = doc[order], item[order], first[order]
        cut = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(item)], strict=False):
            k = int(item[a])
            step = max(1, (1 << 18) // int(self.m[k] + 4 * self.edits[k] + 2))
            for lo in range(a, b, step):
                r = slice(lo, min(lo + step, b))
                edits, end = self.align(k, data, off[doc[r]], off[doc[r] + 1], first[r])
                for d, x, y in zip((doc[r] + first_doc).tolist(), edits.tolist(), (end + shift).tolist(), strict=True):
                    if x <= self.edits[k]:
                        found[d, k, y] = min(x, found.get((d, k, y), x))
        raw = data.tobytes() if self.short else b""
        for k in self.short:
            want = self.texts[k].tobytes()
            at = raw.find(want) if want else -1
            while at >= 0:
                d = int(np.searchsorted(off, at, side="right")) - 1
                if at + len(want) <= off[d + 1]:
                    found[d + first_doc, k, at + len(want) - int(off[d]) + shift] = 0
                at = raw.find(want, at + 1)


_LEAKS = "array<struct<item_id:bigint,edits:bigint,end:bigint>>"


def _indexes(benchmark: DataFrame, item: str, item_text: str, p: LeakParams) -> list:
    """Broadcast indexes of the distinct items, each over about part_bytes at most, with the ids of each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where("t <> ''")
    items = items.groupBy("t").agg(F.collect_list("i").alias("ids"), F.count("*").alias("n"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = total // p.part_bytes + 1
    out = []
    for k in range(parts):
        part = sorted(items.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k).collect(), key=lambda r: r.t)
        out.append(spark.sparkContext.broadcast(Items([sorted(r.ids) + [None] * (r.n - len(r.ids)) for r in part], [r.t for r in part], p)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", p: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, leaks array<struct<item_id, edits, end>>) of every document; end is a byte offset."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    indexes = _indexes(benchmark, item, item_text, p)
    if len(indexes) == 1:
        return rows.mapInArrow(lean(_marker(indexes[0], p)), f"doc_id long, leaks {_LEAKS}")
    hits = _hits(rows.select("text"), indexes, p).select(F.col("digest").alias("__digest"), "leaks")
    marked = rows.select("doc_id", _digest("text").alias("digest")).join(hits, F.col("digest") == F.col("__digest"), "left")
    return marked.select("doc_id", F.coalesce("leaks", F.array().cast(_LEAKS)).alias("leaks"))


def _digest(text: str):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _hits(rows: DataFrame, indexes: list, p: LeakParams) -> DataFrame:
    """(digest, leaks) of the texts that hold items of any part. Each part has a scan of its own, so that no worker
    holds two indexes; only hits leave it."""
    found = None
    for index in indexes:
        part = rows.select(_digest("text").alias("digest"), "text").mapInArrow(lean(_marker(index, p)), f"digest string, leaks {_LEAKS}").where(F.size("leaks") > 0).dropDuplicates(["digest"])
        found = part if found is None else found.unionByName(part)
    return found.groupBy("digest").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))


def _marker(index, p: LeakParams):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("end", pa.int64())]))

    def mark(batches):
        items = index.value
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            got: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, j in blocks(off, p.block_bytes):
                for d, k, x, y in items.leaks(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                    got[i + d] += [{"item_id": name, "edits": x, "end": y} for name in items.ids[k]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], names=[batch.schema.names[0], "leaks"])

    return mark


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", p: LeakParams = LeakParams()) -> DataFrame:
    """docs without the documents that hold an item. Of one part of items, rows are filtered where they are read and
    nothing is shuffled."""
    import pyarrow as pa

    place = docs.columns.index(text)

    def clean(index):
        def work(batches):
            items = index.value
            for batch in batches:
                data, off = text_buffers(batch.column(place))
                keep = np.ones(batch.num_rows, bool)
                for i, j in blocks(off, p.block_bytes):
                    keep[[i + d for d, *_ in items.leaks(data[off[i] : off[j]], off[i : j + 1] - off[i])]] = False
                yield batch.filter(pa.array(keep))

        return work

    indexes = _indexes(benchmark, item, item_text, p)
    if len(indexes) == 1:
        return docs.mapInArrow(lean(clean(indexes[0])), docs.schema)
    hits = _hits(docs.select(F.col(text).alias("text")), indexes, p).select(F.col("digest").alias("__digest"))
    return docs.join(hits, _digest(text) == F.col("__digest"), "left_anti")
