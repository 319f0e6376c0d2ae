"""Near-duplicate classes by improved consistent weighted sampling (ICWS).

1. Texts are shingles of five words (fewer if the text is shorter) with weight tf * idf. Document
   frequencies are counted over all documents in 2**18 hashed buckets (the hashing trick), so the table has
   a fixed size and common shingles stand out at any corpus size.
2. ICWS draws one shingle a hash function: over r, c ~ Gamma(2, 1) and beta ~ U(0, 1) of (shingle, function),
   t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r, and the smallest a wins; two texts agree on
   (shingle, t) with the probability of their weighted Jaccard similarity.
3. Functions are banded; texts sharing a band are candidates. Nothing pairs all members of a band: each
   member is verified against the band's most typical text (least mean idf), and only members below the
   threshold (left over) are compared with the rest of that text's group, in blocks of bounded size, where
   one matrix product gives all exact similarities and only links leave the block; in groups with many of them,
   only where two texts share one of their rarest shingles, as all links do. Every candidate pair is so either
   verified, or too unlike, or already in one class: no cap, no lost link.
4. Links are closed to classes by distributed connected components.

Texts that are equal byte for byte are one node; a task computes each text it meets once.

Defined cases: null texts are empty; a text without words is alone in a class of its own; a class is named
by its smallest document id (null ids belong to the class of their text, and name it only if all are
null); repeated rows are returned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, blocks, lean, mix64, shingle_hashes, text_buffers, word_hashes, written
from .components import connected_components

BUCKETS = 1 << 18
_BITS = 44  # of a shingle's hash within a text
_MASK = np.uint64((1 << _BITS) - 1)


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 12
    rows: int = 4
    block: int = 64  # texts a side of a block comparison
    slot: int = 128  # texts held against one copy of their head's text
    block_bytes: int = 1 << 19  # text bytes worked on at once


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their frequency, and the number per text."""
    words, n = word_hashes(data, offsets)
    hashes, n = shingle_hashes(words, n, k)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = np.sort(doc << np.uint64(_BITS) | hashes >> np.uint64(64 - _BITS))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    own = key[at]
    tf = np.diff(np.append(at, len(key)))
    per = np.bincount((own >> np.uint64(_BITS)).astype(np.int64), minlength=len(n)) if len(own) else np.zeros(len(n), np.int64)
    return own & _MASK, tf, per


def bucket(s: np.ndarray) -> np.ndarray:
    return ((s * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(46)).astype(np.int64)


def document_frequency(docs: DataFrame, text: str, p: MinHashParams) -> tuple[np.ndarray, int]:
    """Documents a bucket and all documents; at most BUCKETS rows come to the driver."""
    import pyarrow as pa

    def count(batches):
        tally, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            n += batch.num_rows
            for i, j in blocks(off, p.block_bytes):
                s, _, _ = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], p.shingle)
                tally += np.bincount(bucket(s), minlength=BUCKETS)
        at = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(tally[at], n))], names=["bucket", "n"])

    counts = docs.select(text).mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    with arrow_rows(docs.sparkSession, 2000):
        rows = counts.toArrow()
    at, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(BUCKETS, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def idf_table(df: np.ndarray, n_docs: int) -> np.ndarray:
    return (1 + np.log((1 + n_docs) / (1 + np.minimum(df, n_docs)))).astype(np.float32)


_TABLE = 1 << 17


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of _TABLE equal steps, by Newton's method."""
    u = (np.arange(_TABLE) + 0.5) / _TABLE
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
        x = np.minimum(x, 40)
    return x


class Sampler:
    """ICWS signatures of texts given as distinct weighted shingles."""

    def __init__(self, functions: int, seed: int = 7):
        gamma = _gamma_table()
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.inverse_r = (1 / gamma).astype(np.float32)
        odd = np.random.default_rng(seed).integers(0, 1 << 63, functions, dtype=np.uint64)
        self.odd = odd << np.uint64(1) | np.uint64(1)

    def sign(self, s: np.ndarray, weight: np.ndarray, per: np.ndarray) -> np.ndarray:
        """uint64 [texts, functions]; every text has a shingle."""
        out = np.zeros((len(per), len(self.odd)), np.uint64)
        if not len(s):
            return out
        mixed, log_w = mix64(s), np.log(weight).astype(np.float32)
        starts = np.cumsum(per) - per
        doc = np.repeat(np.arange(len(per)), per)
        low = np.uint64(_TABLE - 1)
        for f, odd in enumerate(self.odd):
            h = mixed * odd
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            ir = (h & low).astype(np.int32)
            ic = (h >> np.uint64(17) & low).astype(np.int32)
            beta = (h >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            r = self.r[ir]
            t = np.floor(log_w * self.inverse_r[ir] + beta)
            log_a = self.log_c[ic] - r * (t - beta + 1)
            least = np.minimum.reduceat(log_a, starts)
            win = np.flatnonzero(log_a == np.repeat(least, per))
            out[doc[win], f] = mix64(mixed[win] + t[win].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return out

    def bands(self, signature: np.ndarray, rows: int) -> np.ndarray:
        n, functions = signature.shape
        key = np.zeros((n, functions // rows), np.uint64)
        for k in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k::rows][:, : functions // rows])
        return key


def sign_documents(docs: DataFrame, key: str, text: str, idf, p: MinHashParams) -> DataFrame:
    """(doc_id, node, typical, bands): node is the text's digest; bands is null for a text without words
    and where the task has met the same text before."""
    import pyarrow as pa

    def sign(batches):
        sampler, seen = Sampler(p.bands * p.rows), OrderedDict()
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for i, j in blocks(off, p.block_bytes):
                raw = data[off[i] : off[j]].tobytes()
                cut = (off[i : j + 1] - off[i]).tolist()
                node = [hashlib.md5(raw[a:b]).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                fresh = np.zeros(j - i, bool)
                for k, d in enumerate(node):
                    if d not in seen:
                        fresh[k] = True
                        seen[d] = None
                while len(seen) > 200_000:
                    seen.popitem(last=False)
                # the fresh texts alone, side by side
                size = np.diff(off[i : j + 1])
                part = data[off[i] : off[j]][np.repeat(fresh, size)]
                part_off = np.concatenate([[0], np.cumsum(size[fresh])])
                s, tf, per = shingles(part, part_off, p.shingle)
                some = per > 0
                weights = idf.value[bucket(s)]
                typical = np.zeros(len(per), np.float32)
                if some.any():
                    starts = (np.cumsum(per) - per)[some]
                    typical[some] = np.add.reduceat(weights, starts) / per[some]
                bands = sampler.bands(sampler.sign(s, weights * tf, per[some]), p.rows)
                full = np.flatnonzero(fresh)[some]
                count = np.zeros(j - i, np.int32)
                count[full] = p.bands
                mask = count == 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(bands.view(np.int64).ravel()), mask=pa.array(mask))
                typical_all = np.zeros(j - i, np.float32)
                typical_all[fresh] = typical
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(node, pa.binary()), pa.array(typical_all), lists], names=["doc_id", "node", "typical", "bands"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(sign), "doc_id long, node binary, typical float, bands array<long>")


def weighted_jaccard(a, b) -> float:
    """Of two (shingles, weight) with distinct ascending shingles."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum()) if len(both) else 0.0
    high = float(a[1].sum()) + float(b[1].sum()) - low
    return low / high if high > 0 else 0.0


def _vectors(texts, idf, p: MinHashParams) -> list[tuple[np.ndarray, np.ndarray]]:
    data, off = text_buffers(texts)
    out = []
    for i, j in blocks(off, p.block_bytes):
        s, tf, per = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], p.shingle)
        w = (idf[bucket(s)] * tf).astype(np.float64)
        ends = np.cumsum(per)
        out += [(s[b - n : b], w[b - n : b]) for b, n in zip(ends.tolist(), per.tolist(), strict=True)]
    return out


def rare_shingles(vector: tuple[np.ndarray, np.ndarray], idf: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest shingles of a text, that hold just over 1 - threshold of its weight."""
    s, w = vector
    order = np.lexsort((s, -idf[bucket(s)]))
    sums = np.cumsum(w[order])
    return s[order[: int(np.searchsorted(sums, (1 - threshold + 1e-9) * sums[-1], side="right")) + 1]] if len(s) else s


def block_links(vectors: list, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (x, y) of similarity >= threshold between left and right members (indices into vectors).

    Only shingles that two of the texts share count towards an intersection; each level of a shingle's
    weight is a column of its own, so that a product of indicator rows sums minima exactly, slice by slice.
    """
    n = len(vectors)
    own = np.repeat(np.arange(n), [len(v[0]) for v in vectors])
    all_s = np.concatenate([v[0] for v in vectors]) if n else np.zeros(0, np.uint64)
    all_w = np.concatenate([v[1] for v in vectors]) if n else np.zeros(0)
    order = np.lexsort((all_w, all_s))
    s, w, own = all_s[order], all_w[order], own[order]
    change = np.ones(len(s), bool)
    change[1:] = s[1:] != s[:-1]
    group = np.cumsum(change) - 1
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    keep = size[group] > 1 if len(group) else np.zeros(0, bool)
    s, w, own = s[keep], w[keep], own[keep]
    total = np.array([v[1].sum() for v in vectors])
    low = np.zeros((len(left), len(right)))
    # levels: distinct (shingle, weight), each worth its step above the level below
    step = np.ones(len(s), bool)
    step[1:] = (s[1:] != s[:-1]) | (w[1:] != w[:-1])
    level = np.cumsum(step) - 1
    head = np.flatnonzero(step)
    ls, lw = s[head], w[head]
    below = np.where(np.append(False, ls[1:] == ls[:-1]), np.append(0.0, lw[:-1]), 0.0) if len(ls) else lw
    worth = lw - below
    block_start = np.flatnonzero(np.append(True, ls[1:] != ls[:-1])) if len(ls) else np.zeros(0, np.int64)
    base = np.repeat(block_start, np.diff(np.append(block_start, len(ls)))) if len(ls) else block_start
    first = base[level] if len(level) else level  # a text has all levels of a shingle up to its own
    for a in range(0, len(ls), 4096):
        b = min(a + 4096, len(ls))
        rows = np.flatnonzero((level >= a) & (first < b))
        if not len(rows):
            continue
        has = np.zeros((n, b - a))
        lo, hi = np.maximum(first[rows], a) - a, np.minimum(level[rows], b - 1) - a
        count = hi - lo + 1
        ends = np.cumsum(count)
        has[np.repeat(own[rows], count), np.arange(int(ends[-1])) - np.repeat(ends - count, count) + np.repeat(lo, count)] = 1
        low += (has[left] * worth[a:b]) @ has[right].T
    high = total[left][:, None] + total[right][None, :] - low
    hit = low >= threshold * high - 1e-9
    i, j = np.nonzero(hit & (left[:, None] != right[None, :]))
    return [(int(left[x]), int(right[y])) for x, y in zip(i, j, strict=True)]


def _forest(links: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Links enough to connect what the links connect."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", p: MinHashParams = MinHashParams()) -> DataFrame:
    """(doc_id, class_id, n_links): n_links counts the texts verified as links of the document's text that
    closed its class; 0 for a text without near copies."""
    return _classed(docs, key, text, p, Scratch()).select("doc_id", "class_id", "n_links")


def _classed(docs: DataFrame, key: str, text: str, p: MinHashParams, scratch: Scratch) -> DataFrame:
    """near_duplicates with the text's digest, a digest that stands for its class, and whether it has words; the
    tables that the result reads stay in scratch, all others are deleted."""
    import pyarrow as pa

    spark, written = docs.sparkSession, scratch.written
    df, n_docs = document_frequency(docs, text, p)
    idf = spark.sparkContext.broadcast(idf_table(df, n_docs))  # 1 MB whatever the input
    with arrow_rows(spark, 2000):
        signed = written(sign_documents(docs, key, text, idf, p), "signed")
    nodes = written(signed.where("bands is not null").groupBy("node").agg(F.min("typical").alias("typical"), F.first("bands").alias("bands")), "nodes")
    entry = nodes.select("node", "typical", F.posexplode("bands").alias("band", "value"))
    heads = entry.groupBy("band", "value").agg(F.min(F.struct("typical", "node")).alias("m"), F.count("*").alias("n")).where("n > 1")
    heads = written(heads.select("band", "value", F.col("m.node").alias("head")), "heads")
    tested = entry.join(heads, ["band", "value"]).where("node <> head").select("node", "head").distinct()
    tested = written(tested, "tested")
    # the texts of all candidates: one row a node
    wanted = tested.select("node").union(tested.select(F.col("head").alias("node"))).distinct()
    ids = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = written(wanted.join(ids, "node"), "wanted")
    raw = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # always by shuffle: whether the candidates fit a broadcast must not decide the plan
    texts = raw.join(wanted.hint("merge"), raw.doc_id.eqNullSafe(wanted.doc_id)).where(F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("node")).select("node", "text")
    texts = written(texts.withColumn("n", F.lit(1)).groupBy("node").agg(F.first("text").alias("text")), "texts")

    def verify(batches):
        name = vector = None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                heads_, is_head = part.column(0).to_pylist(), part.column(1).to_pylist()
                got, sims = [], []
                for k, own in enumerate(_vectors(part.column(3), idf.value, p)):
                    if is_head[k]:
                        name, vector = heads_[k], own
                    elif heads_[k] == name:
                        got.append(k)
                        sims.append(weighted_jaccard(own, vector))
                    else:
                        raise ValueError("a member came before its head")
                part = part.take(pa.array(got, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(sims, pa.float64())], names=["node", "head", "sim"])

    # the members of a head are dealt to slots of bounded size; each slot has the head's text once, ahead of its members
    slots = tested.groupBy("head").agg(F.ceil(F.count("*") / F.lit(p.slot)).cast("int").alias("slots"))
    members = tested.join(texts, "node").join(slots, "head").select("head", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int").alias("slot"), F.lit(False).alias("is_head"), "node", "text")
    ahead = slots.join(texts.withColumnRenamed("node", "head"), "head").select("head", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(True).alias("is_head"), F.col("head").alias("node"), "text")
    dealt = members.unionByName(ahead).repartition("head", "slot").sortWithinPartitions("head", "slot", F.desc("is_head"))
    with arrow_rows(spark, 512):
        stars = written(dealt.select("head", "is_head", "node", "text").mapInArrow(lean(verify), "node binary, head binary, sim double"), "stars")
    links = stars.where(F.col("sim") >= p.threshold).select(F.col("node").alias("src"), F.col("head").alias("dst"))
    links = links.union(_left_over(stars, texts, idf, p, scratch))
    links = written(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct(), "links")
    classes = connected_components(links)
    degree = links.select(F.col("src").alias("node")).union(links.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    member = written(classes.join(degree, "node").join(ids.select("node", F.col("doc_id").alias("least")), "node"), "member")
    names = written(member.groupBy("component").agg(F.min("least").alias("class_id")), "names")
    named = written(member.join(names, "component").select("node", "component", "class_id", "n_links"), "named")
    # copies of one text without near copies share the text's smallest id; texts without words stay alone
    alone = signed.groupBy("node").agg(F.min("doc_id").alias("own_id"), F.count("bands").alias("worded"))
    worded = F.col("worded") > 0
    full = alone.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("part"), worded.alias("worded"), F.when(worded, F.coalesce("class_id", "own_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    full = written(full, "classes")
    scratch.drop(keep=(signed, full))
    # the class of a text without words is the row itself; that of a text without ids has no name
    return signed.select("doc_id", "node").join(full, "node").select("doc_id", "node", "part", "worded", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_links")


def _left_over(stars: DataFrame, texts: DataFrame, idf, p: MinHashParams, scratch: Scratch) -> DataFrame:
    """Links of the members that are not linked to their head, with the other members of the head's group.

    A group's linked members are one class already, so only left x left and left x linked blocks are made. Where more
    than a block is left over, members meet only where they share one of their rarest shingles: two texts of
    similarity t have a common shingle among those that hold the rarest 1 - t of each one's weight, so no link is lost,
    and texts that share a template alone do not meet. Members are dealt to blocks by hash; a block pair holds 2 *
    block texts on average and is one key.
    """
    import pyarrow as pa

    group = stars.select("head", "node", (F.col("sim") >= p.threshold).alias("linked"))
    count = lambda df, *key: df.groupBy(*key).agg(F.sum((~F.col("linked")).cast("long")).alias("n_left"), F.sum(F.col("linked").cast("long")).alias("n_linked")).where("n_left > 1 or (n_left = 1 and n_linked > 0)")
    sizes = scratch.written(count(group, "head"), "left-sizes")
    few = group.join(sizes.where(F.col("n_left") <= p.block).select("head"), "head").select("head", F.lit(0).cast("long").alias("rare"), "node", "linked")
    many = group.join(sizes.where(F.col("n_left") > p.block).select("head"), "head").join(texts, "node").select("head", "node", "linked", "text")

    def rarest(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                lists = [rare_shingles(v, idf.value, p.threshold) for v in _vectors(part.column(3), idf.value, p)]
                n = np.array([len(x) for x in lists])
                rows = pa.array(np.repeat(np.arange(len(n)), n))
                rare = pa.array(np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), rare, part.column(1).take(rows), part.column(2).take(rows)], names=["head", "rare", "node", "linked"])

    with arrow_rows(stars.sparkSession, 512):
        shared = scratch.written(many.mapInArrow(lean(rarest), "head binary, rare long, node binary, linked boolean"), "rare")
    met = few.unionByName(shared)
    parts = lambda c: F.ceil(F.col(c) / p.block).cast("int")
    sizes = scratch.written(count(met, "head", "rare").select("head", "rare", parts("n_left").alias("bl"), parts("n_linked").alias("bs")), "met-sizes")
    g = met.join(sizes, ["head", "rare"])
    slot = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("bs")).otherwise(F.col("bl"))).cast("int")
    g = g.withColumn("slot", slot)
    # block pairs: (left i, left j) with i <= j, then (left i, linked j) as (i, bl + j)
    others = F.when(F.col("linked"), F.transform(F.sequence(F.lit(0), F.col("bl") - 1), lambda i: F.struct(i.alias("a"), (F.col("bl") + F.col("slot")).alias("b"))))
    mine = F.transform(F.sequence(F.lit(0), F.col("bl") + F.col("bs") - 1), lambda j: F.struct(F.least(j, F.col("slot")).alias("a"), F.greatest(j, F.col("slot")).alias("b")))
    g = g.select("head", "rare", "node", "linked", "slot", F.explode(others.otherwise(mine)).alias("pair"))
    # in which half of the pair a member stands: 1 first, 2 second, 3 both (a block with itself)
    half = F.when(F.col("linked"), 2).otherwise(F.when(F.col("pair.a") == F.col("slot"), 1).otherwise(0) + F.when(F.col("pair.b") == F.col("slot"), 2).otherwise(0))
    g = g.select("node", "head", "rare", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), half.alias("half"))
    g = g.join(texts, "node")

    def compare(pdf_key, table):
        nodes_, half_ = table.column("node").to_pylist(), table.column("half").to_numpy()
        vectors = _vectors(table.column("text"), idf.value, p)
        left, right = np.flatnonzero(half_ & 1), np.flatnonzero(half_ & 2)
        found = _forest(block_links(vectors, left, right, p.threshold), len(nodes_))
        return pa.table({"src": pa.array([nodes_[a] for a, _ in found], pa.binary()), "dst": pa.array([nodes_[b] for _, b in found], pa.binary())})

    return g.groupBy("head", "rare", "a", "b").applyInArrow(compare, "src binary, dst binary")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", p: MinHashParams = MinHashParams()) -> DataFrame:
    """docs with one document of each class: one whose id names it, or one of a class without ids. Rows are told by
    id and text, so an id may repeat with other texts; of repeated rows one is kept. Texts without words all stay."""
    scratch = Scratch()
    found = written(_classed(docs, key, text, p, scratch), "classed")
    scratch.drop()
    first = found.where("class_id <=> doc_id").groupBy("part", "class_id").agg(F.min("node").alias("__node"), F.first("worded").alias("worded"), F.count("*").alias("n"))
    first = written(first.select(F.col("class_id").alias("__first"), "__node", (F.col("worded") & (F.col("n") > 1)).alias("__again")), "first")
    node = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    same = docs[key].cast("long").eqNullSafe(first["__first"]) & (node == first["__node"])
    if first.where("__again").isEmpty():
        return docs.join(first.hint("merge"), same, "left_semi")
    kept = docs.join(first.hint("merge"), same)
    again = kept.where("__again").dropDuplicates(["__first", "__node"])
    return kept.where("not __again").unionByName(again).select(*docs.columns)
