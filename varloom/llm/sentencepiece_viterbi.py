"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Words of equal length advance together: at every position the substrings that end there are hashed from
prefix hashes, probed in the sorted piece keys, scored, and the vectorised maximum leaves a backpointer.
For a BPE model a path's score is the sum of piece scores over steps that BPE itself could have left
standing, minus infinity otherwise: a step is allowed if merging would never have joined the two pieces
across their boundary. Exactly one path survives, and it is the library's own segmentation.

Characters outside the vocabulary become byte pieces. Each distinct word is encoded once a block. A run of over
160 characters without a space is searched in overlapping chunks of 144, all side by side.

Defined cases: null or empty texts have no ids and decode to ''; texts of any length are one unit; repeated rows are encoded each; an empty table gives an empty
result; other columns pass through `encode` untouched.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, mix64, release, text_buffers
from .token_files import _Codes, gather

SPACE = "▁"
_B = np.uint64(0x9E3779B97F4A7C15)
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_NEVER = np.int64(1) << 62
STRIDE, OVERLAP = 96, 48
LONG = 160  # characters of a word from which it is searched in chunks
_CHUNK_CHARS = 1 << 20  # characters searched at once
_DECODED = 1 << 16  # ids decoded at once


@dataclass
class Model:
    """Piece tables; bounded by the vocabulary."""

    pieces: list[str]
    rank: np.ndarray  # int64: merge order, -1 for single characters
    usable: np.ndarray  # bool: a normal piece that merging its own characters yields
    left: np.ndarray  # int32: the two pieces its last merge joined, -1 for single characters
    right: np.ndarray
    byte_id: np.ndarray  # int32[256]
    max_len: int
    keys: np.ndarray  # sorted uint64 hashes of all normal pieces
    key_ids: np.ndarray
    raw: np.ndarray  # uint64 polynomial of each piece, before mixing
    length: np.ndarray
    is_byte: np.ndarray


def _poly(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_B) + ord(c) + 1) & (1 << 64) - 1
    return h


def _merge(symbols: list[str], score: dict[str, int]) -> list[str]:
    """Merging of best pairs, leftmost among equals, until one or two symbols are left or nothing joins."""
    while len(symbols) > 2:
        best = min(((score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in score), default=None)
        if best is None:
            break
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


def load_model(file: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(file, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only BPE models with identity normalisation are read")
    pieces = [p.piece for p in proto.pieces]
    n = len(pieces)
    normal = [i for i, p in enumerate(proto.pieces) if p.type == 1]
    score = {pieces[i]: -float(proto.pieces[i].score) for i in normal}
    ids = {pieces[i]: i for i in normal}
    order = {v: k for k, v in enumerate(sorted(set(score.values())))}
    rank = np.full(n, -1, np.int64)
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    usable = np.zeros(n, bool)
    for i in normal:
        p = pieces[i]
        usable[i] = len(p) == 1
        if len(p) > 1:
            rank[i] = order[score[p]]
            parts = {p[a:b] for a in range(len(p)) for b in range(a + 2, len(p) + 1)} - {p}
            two = _merge(list(p), {s: score[s] for s in parts if s in score})
            if len(two) == 2 and (two[0] in ids or len(two[0]) == 1) and (two[1] in ids or len(two[1]) == 1):
                left[i], right[i], usable[i] = ids.get(two[0], -1), ids.get(two[1], -1), True
    byte_id = np.full(256, 0, np.int32)
    is_byte = np.zeros(n, bool)
    for i, p in enumerate(proto.pieces):
        if p.type == 6:
            byte_id[int(p.piece[3:5], 16)] = i
            is_byte[i] = True
    raw = np.array([_poly(p) for p in pieces], np.uint64)
    length = np.array([len(p) for p in pieces], np.int64)
    hashed = mix64(raw[normal] + length[normal].astype(np.uint64))
    at = np.argsort(hashed)
    return Model(pieces, rank, usable, left, right, byte_id, int(length[normal].max()), hashed[at], np.array(normal, np.int32)[at], raw, length, is_byte)


class Viterbi:
    def __init__(self, model: Model):
        self.m = model
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * model.max_len, _B)]))
        self.seen = np.zeros(1 << 20, bool)  # a probe's first look: low bits of the piece keys
        self.seen[(model.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def probe(self, poly: np.ndarray, length) -> np.ndarray:
        """Piece ids of substrings by their polynomial and length, -1 where none."""
        h = mix64(poly + np.asarray(length).astype(np.uint64))
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.m.keys, h[maybe]), len(self.m.keys) - 1)
            hit = self.m.keys[at] == h[maybe]
            out[maybe[hit]] = self.m.key_ids[at[hit]]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of pieces a and b ends with exactly those two pieces.

        Backwards in time, the symbols at the boundary are those on a's right and b's left edge; at each
        moment their join must not come before the merge that takes one of them away (of equal ranks the
        left one comes first).
        """
        m = self.m
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        px, py = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(live):
            joint = self.probe(m.raw[x] * self.power[m.length[y]] + m.raw[y], m.length[x] + m.length[y])
            r = np.where(joint >= 0, m.rank[joint], _NEVER)
            bad = (joint >= 0) & (r < px) & (r <= py)
            ok[live[bad]] = False
            rx, ry = m.rank[x], m.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, px, py, rx, ry = (v[go] for v in (live, x, y, px, py, rx, ry))
            down_x = rx > ry
            nx, ny = m.right[x], m.left[y]
            px, py = np.where(down_x, rx, px), np.where(down_x, py, ry)
            x, y = np.where(down_x, nx, x), np.where(down_x, y, ny)
            known = (x >= 0) & (y >= 0)  # a character without a piece joins nothing
            live, x, y, px, py = (v[known] for v in (live, x, y, px, py))
        return ok

    def encode_equal(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as a (words, length) array of code points; -1-c for a character c without a
        piece. Returns all ids in order and the number of each word."""
        m = self.m
        n, length = chars.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _B + chars[:, j] + np.uint64(1)
        last = np.full((length + 1, n), -1, np.int32)  # the piece that ends here on the standing path
        back = np.zeros((length + 1, n), np.int16)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        unknown = np.int32(-2)
        for i in range(1, length + 1):
            for size in range(1, min(i, m.max_len) + 1):
                j = i - size
                ids = self.probe(prefix[i] - prefix[j] * self.power[size], size)
                if size == 1:
                    ids = np.where(ids >= 0, ids, unknown)
                rows = np.flatnonzero((ids != -1) & (best[j] > -np.inf))
                if size > 1:
                    rows = rows[m.usable[ids[rows]]]
                if j and len(rows):
                    both = np.flatnonzero((ids[rows] >= 0) & (last[j][rows] >= 0))
                    fine = np.ones(len(rows), bool)
                    fine[both] = self.compatible(last[j][rows[both]], ids[rows[both]])
                    rows = rows[fine]
                value = best[j][rows] - np.where(ids[rows] >= 0, m.rank[ids[rows]], 0)
                up = value > best[i][rows]
                rows = rows[up]
                best[i][rows], last[i][rows], back[i][rows] = value[up], ids[rows], size
        out, count = np.full((length, n), -1, np.int64), np.zeros(n, np.int64)
        at, row = np.full(n, length), np.arange(n)
        while len(row):
            ids = last[at[row], row].astype(np.int64)
            lone = ids < 0
            ids[lone] = -2 - chars[row[lone], at[row[lone]] - 1].astype(np.int64)
            out[length - 1 - count[row], row] = ids
            count[row] += 1
            at[row] -= back[at[row], row]
            row = row[at[row] > 0]
        filled = np.arange(length)[:, None] >= length - count[None, :]
        return out.T[filled.T], count

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flats: list[np.ndarray] = []
        lens = np.zeros(len(words), np.int64)
        where = np.zeros(len(words), np.int64)
        start = 0
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            ids, count = self._bytes(*self.encode_long([words[i] for i in long]))
            lens[long], where[long], start = count, np.cumsum(count) - count, len(ids)
            flats.append(ids)
        for size in np.unique(sizes[sizes <= LONG]):
            index = np.flatnonzero(sizes == size)
            if size == 0:
                continue
            text = "".join(words[i] for i in index)
            chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size).astype(np.uint64)
            ids, count = self.encode_equal(chars)
            ids, count = self._bytes(ids, count)
            lens[index] = count
            where[index] = start + np.cumsum(count) - count
            start += len(ids)
            flats.append(ids)
        flat = np.concatenate(flats) if flats else np.zeros(0, np.int64)
        ends = np.cumsum(lens)
        order = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(where - (ends - lens), lens)
        return flat[order].astype(np.int32), lens

    def encode_long(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode_equal for words of any length, as overlapping chunks of one length side by side.

        Where two neighbouring chunks have a piece in common at the same place, the path of the left one up to it and
        that of the right one after it are one path, all of whose neighbours stand: it is the word's only one.
        Where they have none, the right one is searched again from a piece of the left one on, in step with it; failing
        that, both as one, so that a stretch whose neighbours never agree costs as much as one long search.
        """
        chars = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for w in words]
        spans = [_chunks(len(c)) for c in chars]
        found: list[dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]] = [{} for _ in words]
        while True:
            todo = [(k, a, b) for k, s in enumerate(spans) for a, b in s if (a, b) not in found[k]]
            if not todo:
                break
            size = np.array([b - a for _, a, b in todo])
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                step = max(1, _CHUNK_CHARS // int(n))
                for lo in range(0, len(rows), step):
                    part = [todo[r] for r in rows[lo : lo + step]]
                    ids, count = self.encode_equal(np.stack([chars[k][a:b] for k, a, b in part]))
                    for (k, a, b), own in zip(part, np.split(ids, np.cumsum(count)[:-1]), strict=True):
                        width = np.where(own >= 0, self.m.length[np.maximum(own, 0)], 1)
                        found[k][a, b] = own, a + np.cumsum(width) - width
            spans = [_agreeing(s, f) for s, f in zip(spans, found, strict=True)]
        out = [_stitched(s, f) for s, f in zip(spans, found, strict=True)]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _bytes(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece, as the byte pieces of their UTF-8 form."""
        lone = np.flatnonzero(ids < -1)
        if not len(lone):
            return ids, count
        points, inverse = np.unique(-2 - ids[lone], return_inverse=True)
        forms = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in points]
        width = np.ones(len(ids), np.int64)
        width[lone] = np.array([len(f) for f in forms])[inverse]
        start = np.cumsum(width) - width
        out = np.repeat(ids, width)
        for k in range(4):
            has = width[lone] > k
            byte = np.array([f[k] if len(f) > k else 0 for f in forms], np.int64)[inverse[has]]
            out[start[lone[has]] + k] = self.m.byte_id[byte]
        word = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(word, weights=width, minlength=len(count)).astype(np.int64)


def _chunks(n: int, first: int = 0) -> list[tuple[int, int]]:
    """Spans of one length that cover a word from `first` on; they start multiples of 16 apart, but for the last, so that
    runs of one character meet in step."""
    size = STRIDE + OVERLAP
    return [*((a, a + size) for a in range(first, n - size, STRIDE)), (max(n - size, first), n)]


def _common(left: tuple, right: tuple, least: int) -> int | None:
    """Start of the first piece, at `least` or later, that two chunks have at the same place."""
    (a, at_a), (b, at_b) = left, right
    lo = np.searchsorted(at_a, max(least, int(at_b[0])))
    key = lambda ids, at: at * (1 << 32) + (ids + (1 << 31))
    mine = key(a[lo:], at_a[lo:])
    same = mine[np.isin(mine, key(b, at_b), assume_unique=True)]
    return int(same[0] >> 32) if len(same) else None


def _agreeing(spans: list[tuple[int, int]], found: dict) -> list[tuple[int, int]]:
    """spans, mended at their first neighbours that have no piece in common: the right one and all after it start
    anew where a piece of the left one starts, or, if it does already, both become one."""
    least = 0
    for k, (one, two) in enumerate(zip(spans[:-1], spans[1:], strict=True)):
        here = _common(found[one], found[two], least)
        if here is None:
            starts = found[one][1]
            begin = int(starts[np.searchsorted(starts, max(least, two[0]))])
            if begin in (two[0], one[0]):
                return [*spans[:k], (one[0], two[1]), *spans[k + 2 :]]
            return [*spans[: k + 1], *_chunks(spans[-1][1], begin)]
        least = here
    return spans


def _stitched(spans: list[tuple[int, int]], found: dict) -> np.ndarray:
    parts, least = [], 0
    for span, after in zip(spans, [*spans[1:], None], strict=True):
        ids, at = found[span]
        stop = _common(found[span], found[after], least) if after else None
        lo, hi = np.searchsorted(at, least), len(at) if stop is None else np.searchsorted(at, stop)
        parts.append(ids[lo:hi])
        least = stop if stop is not None else least
    return np.concatenate(parts)


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, model: Model):
        self.viterbi = Viterbi(model)
        surface = [b"" if t is None else t for t in self._surfaces(model)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self._reset()

    @staticmethod
    def _surfaces(m: Model):
        for p, byte in zip(m.pieces, m.is_byte, strict=True):
            yield bytes([int(p[3:5], 16)]) if byte else b"" if re.fullmatch(r"<s>|</s>|<unk>", p) else p.replace(SPACE, " ").encode()

    def _reset(self) -> None:
        self.codes, self.chars = _Codes(), 0
        self.flat, self.at = np.zeros(0, np.int32), np.array([0, 0], np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > 600_000 or self.chars > 8_000_000:
            self._reset()
        code, codes, counts = self.codes.__getitem__, [], []
        for text in texts:
            before = len(codes)
            if text:
                if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
                    runs = _RUNS.findall(SPACE + text.replace(" ", SPACE))
                    codes.extend(code(r[1:] if r[0] == SPACE else (r,)) for r in runs)
                else:
                    codes.extend(map(code, text.split(" ")))
            counts.append(len(codes) - before)
        fresh, self.codes.fresh = self.codes.fresh, []
        if fresh:
            self.chars += sum(map(len, fresh))
            ids, lens = self.viterbi.encode_words([k[0] if isinstance(k, tuple) else SPACE + k for k in fresh])
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lens)])
        ids, lens = gather(self.flat, self.at, np.array(codes, np.int64))
        total = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(np.array(counts, np.int64)) if counts else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate([[0], total[ends]]))

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts one after another and their offsets; the leading space mark goes."""
        data, n = gather(self.surface, self.surface_at, ids.astype(np.int64))
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(lens)
        first, last = total[ends - lens], total[ends]
        begins = np.minimum(first, max(len(data) - 1, 0))
        drop = first[(first < last) & (data[begins] == 32)] if len(data) else np.zeros(0, np.int64)
        keep = np.ones(len(data), bool)
        keep[drop] = False
        size = last - first
        size[(first < last) & (data[begins] == 32) if len(data) else np.zeros(len(size), bool)] -= 1
        return data[keep], np.concatenate([[0], np.cumsum(size)])


    def round_trip(self, ids: np.ndarray, lens: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[list[bool], np.ndarray]:
        """Whether each text decodes to itself, and the offsets of the decoded texts; some texts at a time, since
        decoding takes an index of eight bytes for each byte."""
        at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        same, offs = [], [np.zeros(1, np.int64)]
        for i, j in blocks(at, _DECODED):
            one, back_off = self._round_trip(ids[at[i] : at[j]], lens[i:j], data[off[i] : off[j]], off[i : j + 1] - off[i])
            same += one
            offs.append(back_off[1:] + offs[-1][-1])
        return same, np.concatenate(offs)

    def _round_trip(self, ids: np.ndarray, lens: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[list[bool], np.ndarray]:
        back, back_off = self.decode(ids, lens)
        if np.array_equal(back_off, off) and np.array_equal(back, data):
            return [True] * len(lens), back_off
        pairs = zip(back_off[:-1].tolist(), back_off[1:].tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)
        return [np.array_equal(_plain(back[a:b]), _plain(data[c:d])) for a, b, c, d in pairs], back_off


_codecs: dict[str, Codec] = {}


def codec(file: str, model: Model | None = None) -> Codec:
    if file not in _codecs:
        _codecs[file] = Codec(model or load_model(file))
        release()
    return _codecs[file]


def encode(docs: DataFrame, model_file: str, text: str = "text", out: str = "ids", check: str | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with array<int> column `out`: the ids of the whole text; and, if named, the boolean column
    `check`: whether decoding them gives the text back."""
    import pyarrow as pa

    place = docs.columns.index(text)
    keep = [c for c in docs.columns if c not in (out, check)]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` array<int>" + (f", `{check}` boolean" if check else "")

    def work(batches):
        tool = codec(model_file)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = text_buffers(batch.column(place))
            for i, j in blocks(off, block_bytes):
                part = batch.slice(i, j - i)
                ids, lens = tool.encode(part.column(place).to_pylist())
                cut = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
                columns = [*(part.column(part.schema.names.index(c)) for c in keep), pa.ListArray.from_arrays(cut, pa.array(ids, pa.int32()))]
                if check:
                    columns.append(pa.array(tool.round_trip(ids, lens, data[off[i] : off[j]], off[i : j + 1] - off[i])[0], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, out, *[check] * bool(check)])
            batch = data = part = columns = None
            release()  # before the next batch comes

    return docs.mapInArrow(lean(work), schema)


def digest(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32 of little-endian 32-bit ids, n_bytes decoded, round_trip: decoding gives the text back)."""
    return _run(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), model_file, block_bytes)


def _run(rows: DataFrame, model_file: str, block_bytes: int) -> DataFrame:
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = text_buffers(batch.column(1))
            tool = codec(model_file)
            for i, j in blocks(off, block_bytes):
                ids, lens = tool.encode(batch.column(1).slice(i, j - i).to_pylist())
                same, back_off = tool.round_trip(ids, lens, data[off[i] : off[j]], off[i : j + 1] - off[i])
                cut = np.concatenate([[0], np.cumsum(lens)]).tolist()
                whole = ids.astype("<u4")
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(lens), pa.array(crc, pa.int64()), pa.array(np.diff(back_off)), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_crc32", "n_bytes", "round_trip"],
                )
            batch = data = None
            release()

    return rows.mapInArrow(lean(work), "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, round_trip boolean")


def _plain(data: np.ndarray) -> np.ndarray:
    """The space mark is written back as a space, so a text's own marks compare as spaces (byte for byte)."""
    mark = np.frombuffer(SPACE.encode(), np.uint8)
    if len(data) < 3 or not (data == mark[0]).any():
        return data
    return np.frombuffer(data.tobytes().replace(SPACE.encode(), b" "), np.uint8)


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with a text column `out` decoded from the id lists; a null list decodes to ''."""
    import pyarrow as pa

    place = encoded.columns.index(ids)
    keep = [c for c in encoded.columns if c != out]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` string"

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(place)
            lens = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            flat = np.array([i for x in lists.to_pylist() for i in x or ()], np.int64)
            data, off = codec(model_file).decode(flat, lens)
            texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    return encoded.mapInArrow(lean(work), schema)
