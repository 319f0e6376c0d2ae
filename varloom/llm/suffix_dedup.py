"""Removal of byte strings that repeat across documents, by sharded suffix arrays.

Every byte covered by a string of `span` bytes that also starts in a document with a smaller id goes;
overlaps count, and all strings are judged on the input.

1. Sharding. A window (any span bytes of a document) belongs to its anchor: the 16 bytes in it with the
   smallest hash, leftmost first. Equal windows have equal anchors at equal places, so a segment (a maximal
   run of windows with one anchor) can only repeat where its anchor does. A first pass sends the
   fingerprints of anchors alone, five bytes each, and keeps those of two documents or more; the segments
   at such anchors are then sent, with their bytes, to shards by anchor. Equal segments of a bucket of
   documents are sent once, with the smallest document: in the bucket's later documents they are repeats
   already (a combine before the shuffle). An anchor of many buckets (blanks, rules of dashes) is dealt to several
   shards, by the bytes before or after it. A blob goes from each bucket to each pile of shards, so buckets and
   piles grow with the corpus up to `unit_bytes`; segments whose anchor is in over `fan_in` buckets, and only they,
   are combined in steps first.
2. In a shard, segments that share neither the bytes before and with their anchor nor those with and after
   it with another document (half of a window's other bytes lie on one side) are left out, and once more when equal
   ones are one. The distinct others form the shard's text. Its suffix array is made by induced sorting (see sais), the permuted common
   prefixes tell which neighbours agree in span bytes, and a window is a repeat if a neighbour in its run
   of agreeing suffixes comes from a smaller document.
3. The repeats go back to their documents, which are cut.

Documents are dealt to buckets of bounded bytes once; all three steps read that one exchange.

Defined cases: null and empty texts, and texts shorter than span, lose nothing; rows with a null id count
as later than all others, and not as repeats of each other; rows that share an id are one document (no
repeats of each other), and identical rows are worked on once and returned each; an empty table gives an
empty result; other columns pass through `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _powers, blocks, eight_bytes, lean_group, mix64, text_buffers, written
from .sais import common_prefixes, suffix_array

SPAN = 50
GRAM = 16
_PRINT_BITS = 40
_HOT = np.uint64(1) << np.uint64(63)
_VAST = np.uint64(1) << np.uint64(62)
_MARKS = _HOT | _VAST
_BLOCK = 1 << 20  # bytes that are indexed or hashed at once
_SORTED = 1 << 20  # bytes of shards that share a suffix array
NO_ID = np.iinfo(np.int64).max
_META = np.dtype([("anchor", "<u2"), ("size", "<u2"), ("n_places", "<u4"), ("shard", "<u4"), ("doc", "<i8")])
_PLACE = np.dtype([("key", "<u8"), ("offset", "<i8"), ("bucket", "<i4")])
_RUN = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("count", "<i4")])


def _gram_hash(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of the GRAM bytes from each of the first n positions, from the eight bytes at each position."""
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    for later in sorted({8, GRAM - 8}):
        h ^= h >> np.uint64(29)
        h = (h + word[later : later + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix64(h)


def text_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit hash of each whole text."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix64((total[off[1:]] - total[off[:-1]]) * inverse[off[:-1]] + np.diff(off).astype(np.uint64))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of all ranges [start, start + size) one after another."""
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    return np.arange(n) + np.repeat(start - (ends - size), size)


def _pieces(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[_spans(start, size)], with the index of a block at a time."""
    edges = np.append(0, np.cumsum(size))
    out = np.empty(int(edges[-1]), data.dtype)
    for i, j in blocks(edges, _BLOCK):
        out[edges[i] : edges[j]] = data[_spans(start[i:j], size[i:j])]
    return out


class Segments:
    """Anchored segments of a chunk of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, span: int):
        n = len(data)
        self.data = data
        self.first = self.last = self.anchor = np.zeros(0, np.int64)
        width = span - GRAM + 1
        if n < span:
            return
        word = eight_bytes(data)
        grams = n - GRAM + 1
        self.gram = _gram_hash(word, grams)
        low = self.gram & np.uint64(0xFFFFFFFF00000000) | np.arange(grams, dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # anchor of the window that starts here
        ok = np.ones(len(place), bool)
        ends = off[1:]  # windows over a text's end are none
        short = np.unique(_spans(np.maximum(ends - span + 1, off[:-1]), ends - np.maximum(ends - span + 1, off[:-1])))
        ok[short[short < len(ok)]] = False
        head = ok.copy()
        head[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
        tail = ok.copy()
        tail[:-1] &= ~ok[1:] | (place[1:] != place[:-1])
        self.first, self.last = np.flatnonzero(head), np.flatnonzero(tail)  # first and last window
        self.anchor = place[self.first]


@dataclass
class Batch:
    """Segments with their places in documents: meta in order of text, places in order of meta."""

    meta: np.ndarray
    place: np.ndarray
    text: np.ndarray

    def pack(self) -> bytes:
        return np.array([len(self.meta), len(self.place)], "<i8").tobytes() + self.meta.tobytes() + self.place.tobytes() + self.text.tobytes()

    @staticmethod
    def unpack(raw: bytes) -> Batch:
        n, m = np.frombuffer(raw[:16], "<i8").tolist()
        a = 16 + n * _META.itemsize
        b = a + m * _PLACE.itemsize
        return Batch(np.frombuffer(raw[16:a], _META), np.frombuffer(raw[a:b], _PLACE), np.frombuffer(raw[b:], np.uint8))

    @staticmethod
    def join(parts: list[Batch]) -> Batch:
        return Batch(*(np.concatenate([getattr(x, n) for x in parts]) for n in ("meta", "place", "text")))

    def starts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of each segment's text, first and number of its places."""
        size, n = self.meta["size"].astype(np.int64), self.meta["n_places"].astype(np.int64)
        return np.cumsum(size) - size, size, np.cumsum(n) - n, n

    def take(self, rows: np.ndarray) -> Batch:
        start, size, first, n = self.starts()
        return Batch(self.meta[rows], self.place[_spans(first[rows], n[rows])], _pieces(self.text, start[rows], size[rows]))

    def split(self, pile: int = 1) -> list[tuple[int, Batch]]:
        """(shard, its segments), by shard; or by pile of so many shards."""
        whole = self.take(np.argsort(self.meta["shard"], kind="stable"))
        start, size, first, n = whole.starts()
        shard = whole.meta["shard"] // np.uint32(pile)
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
        text_at, place_at = np.append(start, len(whole.text)), np.append(first, len(whole.place))
        out = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(shard)], strict=False):
            out.append((int(shard[a]), Batch(whole.meta[a:b], whole.place[place_at[a] : place_at[b]], whole.text[text_at[a] : text_at[b]])))
        return out

    def combine(self, span: int) -> tuple[Batch, np.ndarray, np.ndarray]:
        """Equal segments as one, with the places of the smallest document; and the runs, with their buckets, of
        all later documents, in which such a segment is a repeat whole."""
        start, size, first, n = self.starts()
        doc = self.meta["doc"]
        content = _content(self.text, start, size)
        order = np.lexsort((doc, content, size))
        same = np.append(False, (content[order][1:] == content[order][:-1]) & (size[order][1:] == size[order][:-1]))
        same[same] = _equal(self.text, start, size, order[np.flatnonzero(same) - 1], order[same])
        group = np.cumsum(~same) - 1
        heads = order[~same]
        later = doc[order] != doc[heads][group]
        old, kept = order[later], order[~later]
        where = _spans(first[old], n[old])
        runs = np.zeros(len(where), _RUN)
        runs["key"], runs["doc"], runs["start"] = self.place["key"][where], np.repeat(doc[old], n[old]), self.place["offset"][where]
        runs["count"] = np.repeat(size[old] - span + 1, n[old])
        meta = self.meta[heads].copy()
        meta["n_places"] = np.bincount(group[~later], weights=n[kept], minlength=len(heads)).astype(np.uint32)
        out = Batch(meta, self.place[_spans(first[kept], n[kept])], _pieces(self.text, start[heads], size[heads]))
        return out, runs, self.place["bucket"][where]


def anchor_prints(data: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hashes, documents) of some texts, each pair once."""
    seg = Segments(data, off, span)
    h, owner = seg.gram[seg.anchor] if len(seg.first) else np.zeros(0, np.uint64), np.searchsorted(off, seg.first, side="right") - 1
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
    return h[new], owner[new]


def name_prints(h: np.ndarray, groups: int) -> np.ndarray:
    """Group number and fingerprint of anchors, as one number: the group deals them out."""
    low = np.uint64((1 << _PRINT_BITS) - 1)
    return (h >> np.uint64(_PRINT_BITS)) % np.uint64(groups) << np.uint64(_PRINT_BITS) | h & low


def pack_prints(once: np.ndarray, twice: np.ndarray) -> bytes:
    """Two ascending lists of fingerprints, as five-byte steps."""
    parts = [np.array([len(once)], "<i8").tobytes()]
    for p in (once, twice):
        step = np.diff(p, prepend=np.uint64(0)).astype("<u8")
        parts.append(step.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes())
    return b"".join(parts)


def unpack_prints(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    out = []
    for part in (raw[8 : 8 + 5 * n], raw[8 + 5 * n :]):
        step = np.zeros((len(part) // 5, 8), np.uint8)
        step[:, :5] = np.frombuffer(part, np.uint8).reshape(5, -1).T
        out.append(np.cumsum(step.view("<u8").ravel(), dtype=np.uint64))
    return out[0], out[1]


def live_prints(blobs: list[bytes], hot_buckets: int, fan_in: int) -> list[np.ndarray]:
    """Of each bucket's fingerprints, those of two documents or more, in the bucket or in another one; marked as hot
    if more than hot_buckets buckets have them, and as vast if more than fan_in do."""
    lists = [unpack_prints(x) for x in blobs]
    every = np.concatenate([np.concatenate(x) for x in lists])
    many = np.concatenate([np.concatenate([np.zeros(len(x[0]), bool), np.ones(len(x[1]), bool)]) for x in lists])
    order = np.argsort(every, kind="stable")
    got = every[order]
    twice = np.zeros(len(got), bool)
    equal = got[1:] == got[:-1]
    twice[1:] |= equal
    twice[:-1] |= equal
    alive = many.copy()
    alive[order] |= twice
    head = np.flatnonzero(np.append(True, ~equal)[: len(got)])
    size = np.diff(np.append(head, len(got)))
    mark = np.zeros(len(got), np.uint64)
    mark[order] = np.repeat(np.where(size > hot_buckets, _HOT, np.uint64(0)) | np.where(size > fan_in, _VAST, np.uint64(0)), size)
    cut = np.cumsum([len(x[0]) + len(x[1]) for x in lists])[:-1]
    return [np.sort((p | m)[a]) for p, m, a in zip(np.split(every, cut), np.split(mark, cut), np.split(alive, cut), strict=True)]


def cut_segments(data: np.ndarray, off: np.ndarray, doc: np.ndarray, bucket: int, span: int, shards: int, live: np.ndarray, marks: np.ndarray, groups: int) -> Batch:
    """The segments at live anchors of some texts; live is ascending, marks tells which of it are hot or vast.
    Those at vast anchors go to as many shards of their own, after the others.

    A segment at a hot anchor is sent as two, by the bytes beside the anchor: windows with `side` bytes or more
    before it, and the others, which have more than `side` after it. Equal windows still meet, since they have
    their anchor at one place."""
    seg = Segments(data, off, span)
    h = seg.gram[seg.anchor] if len(seg.first) else np.zeros(0, np.uint64)
    name = name_prints(h, groups)
    at = np.minimum(np.searchsorted(live, name), len(live) - 1)
    keep = live[at] == name
    anchor, first, last, deal, vast = seg.anchor, seg.first, seg.last, h, (marks[at] & _VAST) > 0
    side, hot = (span - GRAM) // 2, (marks[at] & _HOT) > 0
    if side >= 8 and (keep & hot).any():
        word = eight_bytes(data)
        split = keep & hot
        plain = keep & ~split
        before = split & (first <= anchor - side)
        after = split & (last > anchor - side)
        rows = np.concatenate([np.flatnonzero(x) for x in (plain, before, after)])
        parts = [h[plain], _beside(word, h[before], anchor[before] - side, side), _beside(word, ~h[after], anchor[after] + GRAM, span - GRAM - side + 1)]
        lo = np.concatenate([first[plain], first[before], np.maximum(first[after], anchor[after] - side + 1)])
        hi = np.concatenate([last[plain], np.minimum(last[before], anchor[before] - side), last[after]])
        order = np.argsort(lo, kind="stable")
        anchor, first, last, deal, vast = anchor[rows][order], lo[order], hi[order], np.concatenate(parts)[order], vast[rows][order]
    else:
        anchor, first, last, deal, vast = anchor[keep], first[keep], last[keep], deal[keep], vast[keep]
    size = last - first + span
    owner = np.searchsorted(off, first, side="right") - 1
    place, meta = np.zeros(len(first), _PLACE), np.zeros(len(first), _META)
    place["key"], place["offset"], place["bucket"] = text_keys(data, off)[owner], first - off[owner], bucket
    meta["anchor"], meta["size"], meta["doc"], meta["n_places"] = anchor - first, size, doc[owner], 1
    meta["shard"] = (deal >> np.uint64(8)) % np.uint64(shards) + np.where(vast, np.uint64(shards), np.uint64(0))
    return Batch(meta, place, data[_spans(first, size)])


def _beside(word: np.ndarray, h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """h with the n bytes from each position (8 at least)."""
    for depth in [*range(0, n - 7, 8), n - 8]:
        h = mix64((h ^ word[at + depth]) * np.uint64(0x9E3779B97F4A7C15))
    return h


def pile_runs(batch: Batch, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated runs of the documents of some shards, and their buckets."""
    batch = _live(batch, span)
    if not len(batch.meta):
        return np.zeros(0, _RUN), np.zeros(0, np.int32)
    batch, whole, whole_bucket = batch.combine(span)
    batch = _live(batch, span)  # equal segments no longer keep each other
    shards = [batch]
    if len(batch.text) > _SORTED:
        shards = []
        for _, x in batch.split():
            if shards and len(shards[-1].text) + len(x.text) <= _SORTED:
                shards[-1] = Batch.join([shards[-1], x])
            else:
                shards.append(x)
    found = [(whole, whole_bucket), *(shard_runs(x, span) for x in shards)]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _live(batch: Batch, span: int) -> Batch:
    start, size, _, _ = batch.starts()
    live = _may_repeat(batch.text, start, size, batch.meta["anchor"].astype(np.int64), batch.meta["doc"], span)
    return batch if live.all() else batch.take(np.flatnonzero(live))


def shard_runs(batch: Batch, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated runs of the documents of distinct segments, and their buckets."""
    if not len(batch.meta):
        return np.zeros(0, _RUN), np.zeros(0, np.int32)
    start, size, first, n = batch.starts()
    doc = batch.meta["doc"]

    # the text: the distinct segments, parted by a symbol below all bytes, and the end below all
    at = start + np.arange(len(size))
    t = np.ones(len(batch.text) + len(size) + 1, np.int32)
    t[-1] = 0
    inside = _spans(at, size)
    t[inside] = batch.text.astype(np.int32) + 2
    sa = suffix_array(t)
    raw = np.zeros(len(t), np.uint8)
    raw[inside] = batch.text
    windows = np.zeros(len(t), bool)
    windows[_spans(at, size - span + 1)] = True
    own = np.full(len(t), NO_ID)
    own[inside] = np.repeat(doc, size)
    # runs of neighbours that agree in span bytes, both of them whole windows
    real = windows[sa]
    linked = (common_prefixes(t, sa, raw) >= span)[sa] & real
    linked[1:] &= real[:-1]
    linked[0] = False
    head = np.flatnonzero(~linked)
    smallest = np.minimum.reduceat(own[sa], head)
    repeat = np.zeros(len(t), bool)
    repeat[sa] = real & (own[sa] > np.repeat(smallest, np.diff(np.append(head, len(sa)))))

    # each run of repeated windows of a segment, for each of the segment's places
    begin = np.flatnonzero(repeat & ~np.append(False, repeat[:-1]))
    end = np.flatnonzero(repeat & ~np.append(repeat[1:], False)) + 1
    seg = np.searchsorted(at, begin, side="right") - 1
    where = _spans(first[seg], n[seg])
    runs = np.zeros(len(where), _RUN)
    runs["key"], runs["doc"] = batch.place["key"][where], np.repeat(doc[seg], n[seg])
    runs["start"], runs["count"] = batch.place["offset"][where] + np.repeat(begin - at[seg], n[seg]), np.repeat(end - begin, n[seg])
    return runs, batch.place["bucket"][where]


def _may_repeat(text: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Whether a segment shares with another document what any shared window would hold: the anchor with
    the `side` bytes before it, or with those after it, where half of a window's other bytes must lie."""
    side = (span - GRAM + 1) // 2
    live = np.zeros(len(start), bool)
    edges = np.append(start, len(text))
    for lead, room in ((side, anchor >= side), (0, size - anchor - GRAM >= side)):
        rows = np.flatnonzero(room)
        if not len(rows):
            continue
        base, h = start[rows] + anchor[rows] - lead, np.full(len(rows), np.uint64(lead + 1))
        for i, j in blocks(edges, _BLOCK):
            a, b = np.searchsorted(rows, [i, j])
            word = eight_bytes(text[edges[i] : edges[j]])
            for depth in [*range(0, side + GRAM - 7, 8), side + GRAM - 8]:
                h[a:b] = (h[a:b] ^ word[base[a:b] + (depth - edges[i])]) * np.uint64(0x9E3779B97F4A7C15)
                h[a:b] ^= h[a:b] >> np.uint64(32)
        order = np.argsort(h)
        cut = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        d = doc[rows][order]
        # a group lives if it holds two documents
        mixed = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)
        live[rows[order]] |= np.repeat(mixed, np.diff(np.append(cut, len(order))))
    return live


def _content(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment; they fill the text in their order."""
    edges = np.append(start, len(text))
    return np.concatenate([np.zeros(0, np.uint64), *(text_keys(text[edges[i] : edges[j]], edges[i : j + 1] - edges[i]) for i, j in blocks(edges, _BLOCK))])


def _equal(text: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether segments a and b (of equal sizes) are equal byte for byte."""
    out = np.zeros(len(a), bool)
    for i, j in blocks(np.append(0, np.cumsum(size[a])), _BLOCK):
        x, y, n = start[a[i:j]], start[b[i:j]], size[a[i:j]]
        off = text[_spans(x, n)] != text[_spans(y, n)]
        out[i:j] = np.add.reduceat(off, np.cumsum(n) - n) == 0
    return out


def _prime_from(n: int) -> int:
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _bucket_column(doc: Column, text: Column, n: int) -> Column:
    return F.pmod(F.pmod(F.coalesce(doc, F.lit(0)), F.lit(n)) + F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(n)), F.lit(n)).cast("int")


def _packed(pairs: list[tuple], names: list[str]):
    """Arrow table of rows of int32s and a binary last."""
    import pyarrow as pa

    kinds = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    return pa.table([pa.array([x[k] for x in pairs], kind) for k, kind in enumerate(kinds)], names=names)


def _by_bucket(runs: np.ndarray, of: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, packed runs)"""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    order = np.argsort(of, kind="stable")
    runs, of = runs[order], of[order]
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    return [(int(of[a]), pack.compress(runs[a:b].tobytes())) for a, b in zip(at, np.append(at[1:], len(runs)), strict=False)]


def find_repeats(left: DataFrame, bucket: str, key: str, text: str, span: int, shards: int, groups: int, buckets: int, fan_in: int, hot_buckets: int, pile: int = 1, block_bytes: int = 1 << 19) -> DataFrame:
    """(bucket, runs): packed runs of repeated windows, by bucket of documents, from each pile of shards."""
    import pyarrow as pa
    import zstandard

    piles = -(-shards // pile)  # and as many after them, for vast anchors
    shards = piles * pile

    def prints(key_, table):
        """The bucket's anchors, by group."""
        data, off = text_buffers(table.column(text))
        h, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in blocks(off, block_bytes):
            a, b = anchor_prints(data[off[i] : off[j]], off[i : j + 1] - off[i], span)
            h.append(a)
            owner.append(b + i)
        name = np.sort(name_prints(np.concatenate(h), groups))
        head = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
        count = np.diff(np.append(head, len(name)))
        name = name[head]
        group = name >> np.uint64(_PRINT_BITS)
        low = np.uint64((1 << _PRINT_BITS) - 1)
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        pack = zstandard.ZstdCompressor(level=1)
        rows = []
        for a, b in zip(cut, np.append(cut[1:], len(name)), strict=False):
            part, many = name[a:b] & low, count[a:b] > 1
            rows.append((int(group[a]), key_[0].as_py(), pack.compress(pack_prints(part[~many], part[many]))))
        return _packed(rows, ["g", "b", "blob"])

    def live(key_, table):
        tool = zstandard.ZstdDecompressor()
        got = live_prints([tool.decompress(x) for x in table.column("blob").to_pylist()], hot_buckets, fan_in)
        pack, mine = zstandard.ZstdCompressor(level=1), key_[0].as_py() << _PRINT_BITS
        rows = [(b, pack.compress((p | np.uint64(mine)).tobytes())) for b, p in zip(table.column("b").to_pylist(), got, strict=True) if len(p)]
        return _packed(rows, ["b", "blob"])

    def segments(table, lists):
        """The bucket's segments at live anchors, by pile; repeats within it under the pile -1 - bucket."""
        tool, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        if not len(table) or not len(lists):
            return _packed([], ["pile", "part", "blob"])
        own = table.column(bucket)[0].as_py()
        alive = np.sort(np.concatenate([np.frombuffer(tool.decompress(x), np.uint64) for x in lists.column("blob").to_pylist()]))
        order = np.argsort(alive & ~_MARKS)
        marks, alive = alive[order] & _MARKS, alive[order] & ~_MARKS
        data, off = text_buffers(table.column(text))
        ids = table.column(key).cast(pa.int64()).fill_null(NO_ID).to_numpy()
        found = [cut_segments(data[off[i] : off[j]], off[i : j + 1] - off[i], ids[i:j], own, span, shards, alive, marks, groups) for i, j in blocks(off, block_bytes)]
        # equal segments have one anchor and so one shard
        batch = Batch.join(found)
        found.clear()
        if not len(batch.meta):
            return _packed([], ["pile", "part", "blob"])
        batch, runs, _ = batch.combine(span)
        rows = [(k, own, pack.compress(part.pack())) for k, part in batch.split(pile)]
        rows += [(-1 - b, own, x) for b, x in _by_bucket(runs, np.full(len(runs), own))]
        return _packed(rows, ["pile", "part", "blob"])

    def joined(table):
        tool = zstandard.ZstdDecompressor()
        return Batch.join([Batch.unpack(tool.decompress(x.as_buffer())) for x in table.column("blob")])

    def finished(k, table):
        """Repeated runs of a pile, or those found so far, by bucket."""
        if k >= 0:
            return _by_bucket(*pile_runs(joined(table), span))
        tool = zstandard.ZstdDecompressor()
        return [(-1 - k, zstandard.ZstdCompressor(level=1).compress(b"".join(tool.decompress(x) for x in table.column("blob").to_pylist())))]

    def merge(key_, table):
        """Equal segments at vast anchors, of several buckets, as one; other piles are finished."""
        k, part = key_[0].as_py(), key_[1].as_py()
        if k < piles:
            return _packed([(-1 - b, 0, x) for b, x in finished(k, table)], ["pile", "part", "blob"])
        batch, runs, of = joined(table).combine(span)
        pack = zstandard.ZstdCompressor(level=1)
        return _packed([(k, part, pack.compress(batch.pack())), *((-1 - b, 0, x) for b, x in _by_bucket(runs, of))], ["pile", "part", "blob"])

    def reduce(key_, table):
        return _packed(finished(key_[0].as_py(), table), ["bucket", "runs"])

    alive = left.groupBy(bucket).applyInArrow(lean_group(prints), "g int, b int, blob binary").groupBy("g").applyInArrow(lean_group(live), "b int, blob binary")
    sent = left.groupBy(bucket).cogroup(alive.groupBy("b")).applyInArrow(lean_group(segments), "pile int, part int, blob binary")
    while buckets > fan_in:  # a passage of every bucket meets itself at most fan_in times at once
        parts = sent.withColumn("part", F.when(F.col("pile") >= piles, F.floor(F.col("part") / F.lit(fan_in))).otherwise(0).cast("int"))
        sent, buckets = parts.groupBy("pile", "part").applyInArrow(lean_group(merge), "pile int, part int, blob binary"), -(-buckets // fan_in)
    return sent.groupBy("pile").applyInArrow(lean_group(reduce), "bucket int, runs binary")


def _cut(data: np.ndarray, off: np.ndarray, ids: np.ndarray, runs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(removed flag of every byte, removed bytes a text, removed spans a text)"""
    name = lambda doc, key: mix64(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ key)
    mine = name(ids, _content(data, off[:-1], np.diff(off)))
    order = np.argsort(mine, kind="stable")
    wanted = name(runs["doc"], runs["key"])
    at = np.minimum(np.searchsorted(mine[order], wanted), max(len(mine) - 1, 0))
    hit = mine[order][at] == wanted if len(mine) else np.zeros(len(wanted), bool)
    owner = order[at[hit]]
    runs = runs[hit][np.argsort(owner, kind="stable")]
    owner.sort()
    gone, removed, spans = np.zeros(len(data), bool), np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
    for i, j in blocks(off, _BLOCK):
        a, b = np.searchsorted(owner, [i, j])
        begin, ends = off[owner[a:b]] - off[i] + runs["start"][a:b], off[i : j + 1] - off[i]
        diff = np.zeros(ends[-1] + 1, np.int32)
        np.add.at(diff, begin, 1)
        np.add.at(diff, begin + runs["count"][a:b] + span - 1, -1)
        out = np.cumsum(diff[:-1]) > 0
        gone[off[i] : off[j]] = out
        total = np.concatenate([[0], np.cumsum(out)])
        rise = out.copy()
        rise[1:] &= ~out[:-1]
        first = ends[:-1][np.diff(ends) > 0]
        rise[first] = out[first]
        edges = np.concatenate([[0], np.cumsum(rise)])
        removed[i:j], spans[i:j] = total[ends[1:]] - total[ends[:-1]], edges[ends[1:]] - edges[ends[:-1]]
    return gone, removed, spans


@dataclass(frozen=True)
class RepeatParams:
    span: int = SPAN
    bucket_bytes: int = 2 << 20  # of documents
    shard_bytes: int = 2 << 20  # of the text whose repeats meet in a shard
    group_bytes: int = 32 << 20  # of the text whose anchors meet in a group
    fan_in: int = 1024  # buckets whose segments meet at once
    hot_buckets: int = 64  # buckets from which an anchor's segments are dealt by the bytes beside it, too
    units: int = 512  # buckets, and piles of shards, that there may be before they grow
    unit_bytes: int = 8 << 20  # to which they grow

    def __post_init__(self):
        if not GRAM + 2 <= self.span <= 30_000:  # sizes of segments, below twice the span, take two bytes
            raise ValueError(f"span must be in {GRAM + 2} to 30000, not {self.span}")


    def dealt(self, total: int) -> tuple[int, int, int]:
        """Number of buckets, of shards, and of shards in a pile, for so many bytes of text."""
        unit = min(self.unit_bytes, total // self.units)
        return _prime_from(total // max(self.bucket_bytes, unit) + 1), total // self.shard_bytes + 1, max(1, unit // self.shard_bytes)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", p: RepeatParams = RepeatParams(), keep_text: bool = True) -> DataFrame:
    """docs (without its text unless keep_text; bytes of a character cut in two go) with n_bytes, n_removed,
    n_spans and kept_sha256 of each text."""
    ids = docs.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text))).alias("b"))
    seen = ids.agg(F.sum("b").alias("b"), F.max("n").alias("n")).first()
    if (seen["n"] or 0) <= 1:
        return _cut_documents(docs, key, text, seen["b"] or 0, p, keep_text)
    # ids repeat: each distinct (id, text) is worked on once, and its results are joined to all its rows
    mark = "__md5"
    rows = docs.withColumn(mark, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    once = written(rows.groupBy(F.col(key).cast("long").alias("__id"), mark).agg(F.first(text).alias("__text")), "distinct-rows")
    total = once.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    done = _cut_documents(once, "__id", "__text", total, p, True)
    done = written(done.withColumnsRenamed({"__text": "__kept", mark: "__mark"}), "cut-rows")
    back = rows.join(done, rows[key].cast("long").eqNullSafe(done["__id"]) & (rows[mark] == done["__mark"]), "left")
    keep = [c for c in docs.columns if c not in ADDED and (keep_text or c != text)]
    return back.select(*[F.col("__kept").alias(c) if c == text else rows[c] for c in keep], *[done[c] for c in ADDED])


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def _cut_documents(docs: DataFrame, key: str, text: str, total: int, p: RepeatParams, keep_text: bool) -> DataFrame:
    """remove_repeats for documents of which no two share id and text."""
    import pyarrow as pa
    import zstandard

    (buckets, shards, pile), bucket = p.dealt(total), "__bucket"
    left = docs.withColumn(bucket, _bucket_column(F.col(key).cast("long"), F.col(text), buckets))
    runs = find_repeats(left, bucket, key, text, p.span, shards, total // p.group_bytes + 1, buckets, p.fan_in, p.hot_buckets, pile)
    keep = [c for c in docs.columns if c not in ADDED and (keep_text or c != text)]
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in ADDED[:3]), T.StructField(ADDED[3], T.StringType())])

    def cut(table, lists):
        tool = zstandard.ZstdDecompressor()
        found = [np.frombuffer(tool.decompress(x), _RUN) for x in lists.column("runs").to_pylist()]
        data, off = text_buffers(table.column(text))
        ids = table.column(key).cast(pa.int64()).fill_null(NO_ID).to_numpy()
        gone, removed, spans = _cut(data, off, ids, np.concatenate(found) if found else np.zeros(0, _RUN), p.span)
        raw = data[~gone].tobytes()
        at = np.concatenate([[0], np.cumsum(np.diff(off) - removed)]).tolist()
        parts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        columns = {c: table.column(c) for c in keep}
        if keep_text:
            given = table.column(text).to_pylist()
            columns[text] = pa.array([g if not n else x.decode("utf-8", "ignore") for g, n, x in zip(given, removed.tolist(), parts, strict=True)], pa.string())
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        return pa.table(columns | dict(zip(ADDED, (pa.array(np.diff(off)), pa.array(removed), pa.array(spans), sha), strict=True)))

    return left.groupBy(bucket).cogroup(runs.groupBy("bucket")).applyInArrow(lean_group(cut), schema)
