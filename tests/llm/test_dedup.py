"""MinHash near-dedup, suffix arrays and the pipeline."""

import collections
import dataclasses
import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from varloom.llm import minhash, sais, suffix_dedup

SF = "/root/testdata/sf0.001"


# --- suffix arrays


def test_induced_sorting_against_sorting():
    rng = np.random.default_rng(1)
    for n in range(400):
        k = int(rng.choice([2, 3, 5, 300]))
        t = rng.integers(1, k, int(rng.integers(0, 60)))
        if n % 4 == 0:
            t = np.tile(t[: len(t) // 5], 6)
        t = np.append(t, 0)
        as_list = t.tolist()
        assert sais.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: as_list[i:])
    for k in (2, 900):
        t = np.append(rng.integers(1, k, 4000), 0)
        as_list = t.tolist()
        assert sais.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: as_list[i:])


def test_induced_sorting_of_long_runs():
    import time

    rng = np.random.default_rng(5)
    cases = [np.repeat(rng.integers(1, 4, 40), rng.integers(1, 200, 40)) for _ in range(12)]
    cases += [np.full(3000, 2), np.concatenate([np.full(2000, 5), [3], np.full(2000, 5)]), np.tile([1, 2], 1500), np.concatenate([[9], np.full(2500, 4), [9], np.full(700, 4)])]
    for x in cases:
        t = np.append(x, 0)
        raw = bytes(t.astype(np.uint8))
        assert sais.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
    began = time.perf_counter()
    sais.suffix_array(np.append(np.full(1_000_000, 7), 0))
    assert time.perf_counter() - began < 10


def test_common_prefixes():
    rng = np.random.default_rng(2)
    for k in range(20):
        text = rng.integers(97, 97 + 1 + k % 4, 300)
        text[150:250] = text[20:120]
        t = np.append(text, 0)
        sa = sais.suffix_array(t)
        got = sais.common_prefixes(t, sa, t.astype(np.uint8))
        raw = bytes(t.astype(np.uint8))
        common = lambda a, b: next((d for d in range(len(raw) - max(a, b)) if raw[a + d] != raw[b + d]), len(raw) - max(a, b))
        assert [int(got[b]) for b in sa[1:]] == [common(a, b) for a, b in itertools.pairwise(sa.tolist())]


def brute_repeats(rows, n=50):
    first = {}
    late = lambda d: 1 << 62 if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(late(d), first.get(b[i : i + n], 1 << 63))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < late(d):
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def random_docs():
    rng = random.Random(3)
    base = "".join(rng.choice("ab é\n") for _ in range(4000))
    piece = lambda: base[(a := rng.randrange(3900)) : a + rng.randrange(10, 200)]
    return [(i, "".join(piece() for _ in range(6)) + "a" * rng.randrange(200)) for i in range(120)], base


SMALL = suffix_dedup.RepeatParams(bucket_bytes=1 << 13, shard_bytes=1 << 14, group_bytes=1 << 14, fan_in=4, hot_buckets=1)


@pytest.mark.parametrize(("repeated", "span", "hot"), [(False, 50, 1), (True, 50, 1), (False, 50, 64), (False, 200, 1), (False, 33, 1), (False, 20, 1)])
def test_repeats_against_brute_force(spark, repeated, span, hot):
    docs, base = random_docs()
    rng = random.Random(9)  # one anchor of many documents, with other bytes beside it
    docs += [(700 + i, "".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + " " * 40 + "".join(rng.choice(["uv", "w"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    docs += [(500, None), (501, ""), (600, "ab" * 3000), (601, "ab" * 200), (602, "a" * 49), (603, "a" * 50)]
    if repeated:
        docs += [(None, base[:300]), (None, base[:300]), (None, base[200:600]), (3, base[100:700]), (3, base[100:700]), (3, base[50:400])]
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, n_spans string")
    p = dataclasses.replace(SMALL, span=span, hot_buckets=hot)
    got = suffix_dedup.remove_repeats(df, p=p, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(docs, span)


@pytest.mark.parametrize("fan_in", [3, 1024])
def test_repeats_by_large_piles(spark, fan_in):
    """Rows sent grow with what buckets and piles hold, not with their square; vast anchors alone are merged."""
    docs, base = random_docs()
    docs += [(200 + i, f"{i} " * 20 + base[:700] + f"{i}" * 60) for i in range(80)]
    text = sum(len(t.encode()) for _, t in docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    p = dataclasses.replace(SMALL, bucket_bytes=1 << 10, shard_bytes=1 << 10, fan_in=fan_in, units=4, unit_bytes=1 << 14)
    buckets, shards, pile = p.dealt(text)
    piles = -(-shards // pile)
    assert text / 4 < 1 << 16 and buckets <= 20 and shards > 100 and pile > 8
    got = suffix_dedup.remove_repeats(df, p=p, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(docs)
    left = df.withColumn("b", suffix_dedup._bucket_column(df.doc_id, df.text, buckets))
    rows = suffix_dedup.find_repeats(left, "b", "doc_id", "text", p.span, shards, 3, buckets, fan_in, p.hot_buckets, pile).count()
    assert 0 < rows <= buckets * (2 * piles + 1)
    sizes = [suffix_dedup.RepeatParams().dealt(10**k) for k in range(6, 12)]
    assert all(b * -(-s // k) <= max(530**2, 10 ** (2 * e) / (1 << 45)) for e, (b, s, k) in zip(range(6, 12), sizes, strict=True))


def test_sorted_text_of_a_pile(monkeypatch):
    """Equal segments keep only their smallest document, and what no other one shares is not sorted; large piles are sorted in parts."""
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 101, 3000, np.uint8)) for _ in range(3)]
    texts += [texts[0], texts[1], texts[2][:1000] + b"-" + texts[2][1000:], texts[0]]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h, _ = suffix_dedup.anchor_prints(data, off, 50)
    live = np.unique(suffix_dedup.name_prints(h, 1))
    batch = suffix_dedup.cut_segments(data, off, np.arange(len(texts)), 0, 50, 8, live, np.zeros(len(live), np.uint64), 1)
    seen = []
    sort = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda t: (seen.append(len(t)), sort(t))[1])
    want = [(d, n, removed) for d, (_, n, removed, *_) in enumerate(brute_repeats([(i, t.decode()) for i, t in enumerate(texts)]))]
    for most in (1 << 20, 1):
        monkeypatch.setattr(suffix_dedup, "_SORTED", most)
        runs, _ = suffix_dedup.pile_runs(batch, 50)
        _, removed, _ = suffix_dedup._cut(data, off, np.arange(len(texts)), runs, 50)
        assert [(i, len(t), r) for i, (t, r) in enumerate(zip(texts, removed.tolist(), strict=True))] == want
    assert sum(seen) < 2000  # only the segments around the "-", of 21,001 bytes in all


def test_spans_out_of_range_are_refused():
    for span in (0, 17, 30_001):
        with pytest.raises(ValueError, match="span"):
            suffix_dedup.RepeatParams(span=span)


def test_repeats_keep_columns_and_text(spark):
    common = "This sentence of more than fifty bytes stands in both of the documents. "
    df = spark.createDataFrame([(1, "a " + common, "x"), (2, "b é" + common + "c", None), (3, None, "y")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.source, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: ("a " + common, "x", 0), 2: ("b éc", None, len(common)), 3: (None, "y", 0)}
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


# --- near-dedup


def classes_by_brute_force(docs, idf, p):
    texts = sorted({t or "" for _, t in docs})
    vectors = minhash._vectors(pa.array(texts, pa.large_string()), idf, p)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(vectors[i][0]) and minhash.weighted_jaccard(vectors[i], vectors[j]) >= p.threshold:
            parent[root(j)] = root(i)
    name = collections.defaultdict(lambda: None)
    at = {t: i for i, t in enumerate(texts)}
    for d, t in docs:
        r = root(at[t or ""])
        if d is not None and (name[r] is None or d < name[r]):
            name[r] = d
    worded = {t: bool(t.split()) for t in texts}
    return sorted(((d, name[root(at[t or ""])] if worded[t or ""] else d) for d, t in docs), key=str)


def near_docs():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([3, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 8, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs) + group, " ".join(copy)))
    rng.shuffle(docs)
    return docs + [(900, ""), (901, None), (902, " \n"), (903, "\t"), (904, "one"), (905, "one"), (906, "One"), (docs[0][0], docs[0][1]), (None, docs[1][1]), (None, "only here, without an id"), (907, "word " * 5000)]


def test_near_duplicates_against_brute_force(spark):
    docs = near_docs()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, class_id int").repartition(3)
    p = minhash.MinHashParams(bands=40, rows=3, block=8)  # many bands: no link of the brute force is missed
    counts, n = minhash.document_frequency(df, "text", p)
    got = sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(df, p=p).collect()), key=str)
    assert got == classes_by_brute_force(docs, minhash.idf_table(counts, n), p)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_sampling_agrees_as_weighted_jaccard_says():
    rng = np.random.default_rng(3)
    sampler = minhash.Sampler(3000)
    s = np.sort(rng.integers(0, 1 << 44, 60, dtype=np.uint64))
    for lo, hi in ((0, 50), (10, 60)):
        a, b = slice(lo, 45), slice(5, hi)
        wa, wb = rng.random(60) * 3 + 0.2, None
        wb = wa * rng.choice([1.0, 1.0, 2.0], 60)
        one = sampler.sign(s[a], wa[a], np.array([len(s[a])]))
        two = sampler.sign(s[b], wb[b], np.array([len(s[b])]))
        assert (one == two).mean() == pytest.approx(minhash.weighted_jaccard((s[a], wa[a]), (s[b], wb[b])), abs=0.03)


def test_block_links_are_exact():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(40):
        s = np.unique(rng.integers(0, 30, 20).astype(np.uint64))
        vectors.append((s, rng.choice([1.0, 2.0, 3.5], len(s))))
    left, right = np.arange(0, 25), np.arange(15, 40)
    for limit in (0.3, 0.5):
        want = {(i, j) for i in left for j in right if i != j and minhash.weighted_jaccard(vectors[i], vectors[j]) >= limit}
        assert set(minhash.block_links(vectors, left, right, limit)) == want and want


def test_linked_texts_share_a_rare_shingle():
    rng = np.random.default_rng(6)
    idf = minhash.idf_table(rng.integers(0, 1000, minhash.BUCKETS), 1000)
    close = 0
    for _ in range(2000):
        s = np.unique(rng.integers(0, 1 << 44, 40).astype(np.uint64))
        a, b = (np.sort(rng.choice(s, int(rng.integers(25, 41)), replace=False)) if len(s) >= 40 else s for _ in range(2))
        va, vb = (a, idf[minhash.bucket(a)] * rng.integers(1, 3, len(a))), (b, idf[minhash.bucket(b)] * rng.integers(1, 2, len(b)))
        for t in (0.4, 0.6, 0.8):
            if minhash.weighted_jaccard(va, vb) >= t:
                close += 1
                assert set(minhash.rare_shingles(va, idf, t)) & set(minhash.rare_shingles(vb, idf, t))
    assert close > 500


def test_a_template_with_own_parts(spark):
    """Texts alike in a template but under the threshold, with some links among them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(120)]
    rows = []
    for i in range(300):
        own = [word() for _ in range(70)]
        rows.append((i, " ".join(template + own)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(template + own[:-2] + [word(), "x"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = minhash.MinHashParams(bands=24, rows=2, block=8, slot=16)
    counts, n = minhash.document_frequency(df, "text", p)
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(df, p=p).collect())
    want = classes_by_brute_force(rows, minhash.idf_table(counts, n), p)
    assert got == sorted(want) and len({c for _, c in want}) == 300


def test_recall_of_production_parameters(spark):
    """Ids divisible by 5 against all rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = minhash.MinHashParams()
    counts, n = minhash.document_frequency(docs, "text", p)
    idf = minhash.idf_table(counts, n)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    vectors = minhash._vectors(pa.array([t for _, t in rows], pa.large_string()), idf, p)
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, p=p).collect()}
    linked = []
    for (d, t), v in zip(rows, vectors, strict=True):
        if d % 5 == 0 and len(v[0]):
            linked += [(d, e) for (e, u), w in zip(rows, vectors, strict=True) if e != d and len(w[0]) and minhash.weighted_jaccard(v, w) >= p.threshold]
    assert len(linked) > 20
    assert sum(found[a] == found[b] for a, b in linked) >= 0.99 * len(linked)


def test_keep_first(spark):
    docs = near_docs()[:60]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs] + [(docs[0][0], docs[0][1], "s")], "doc_id long, text string, source string")
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in found.values()})


def test_keep_first_tells_rows_by_id_and_text(spark):
    rng = random.Random(3)
    a, c, d, e, f = ([rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(300)] for _ in range(5))
    near = lambda words, k: " ".join(words[:-1] + [f"other{k}"])
    text = " ".join
    rows = [
        (1, text(a)), (1, near(a, 1)), (None, near(a, 2)),  # near copies under one id, and one without
        (4, text(c)), (6, near(c, 1)), (6, text(d)),  # 6 names a class, but its first text belongs to 4
        (None, text(e)), (None, near(e, 1)), (9, text(f)), (9, text(f)),
        (7, ""), (8, None), (None, " "), (None, " "),
    ]
    kept = [(r.doc_id, r.text) for r in minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    one_of = lambda *some: sum(x in some for x in kept) == 1
    assert one_of(*rows[:2]) and one_of(*rows[6:8]) and one_of((9, text(f)))
    rest = [x for x in kept if x not in rows[:2] + rows[6:10]]
    assert sorted(rest, key=str) == sorted([rows[3], rows[5], *rows[10:]], key=str)


# --- pipeline


def plain_quality(text):
    """The kept text of a document, or None, from the rules' definition."""
    import re

    from varloom.llm import quality

    p = quality.QualityParams()
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen = collections.defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    repeated = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    good, lost, size = [], 0, 0
    for line in (text or "").split("\n"):
        n = len([w for w in re.split(r"[\x20\x09-\x0D]+", line) if w])
        bars = len(re.findall(r"[|»›•·]|(?:^|[ \t\n\x0b\f\r])[/>](?:[ \t\n\x0b\f\r]|$)", line))
        bad = n > 0 and (n >= 4 and not re.search(p.sentence_end, line) or re.search(p.navigation, line, re.ASCII) or bars >= max(2, n / 3) or any(x in line.lower() for x in p.boilerplate))
        size += len(line) if n else 0
        lost += len(line) if bad else 0
        if not bad:
            good.append(line)
    return None if lost > 0.5 * size else "\n".join(good)


def nearest(pattern, text):
    """Least edits of the pattern in any part of the text, a row of the table at a time."""
    a = np.frombuffer(text, np.uint8)
    row = np.zeros(len(a) + 1, np.int64)
    step = np.arange(len(a) + 1)
    for j, c in enumerate(pattern, 1):
        new = np.minimum(row + 1, np.append(j, row[:-1] + (a != c)))
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def odd_documents(spark):
    rng = random.Random(12)
    prose = lambda: ". ".join(" ".join(rng.choice("abcdefg") * rng.randint(1, 6) + str(rng.randrange(900)) for _ in range(12)) for _ in range(9)) + "."
    one, two, shared = prose(), prose(), prose()
    rows = [(1, one, 777, "x"), (1, one, 777, "x"), (2, two + " " + shared, 888, None), (3, prose() + " " + shared, None, "y"), (4, None, 1, "z"), (5, "", 2, "z"), (None, prose(), 3, None), (None, prose(), 4, "w"),
            (6, prose() * 40 + "q" * 20_000, 5, "long"), (1, two + " tail", 9, "same id")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, kept_sha256 string"), rows


def test_stages_on_odd_documents(spark, tmp_path):
    import corpus_pipeline as cp

    df, rows = odd_documents(spark)
    items = spark.createDataFrame([(1, rows[3][1][:200]), (2, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, df, str(tmp_path))
        got = out.collect()
        if name == "sentencepiece":
            assert out.columns == ["doc_id", "n_tokens", "round_trip", "ids"] and len(got) == len(rows) and all(r.round_trip for r in got)
            assert sorted(r.n_tokens for r in got)[:2] == [0, 0]
        else:
            assert out.columns == df.columns
            assert {(r.n_bytes, r.kept_sha256) for r in got} <= {r[2:] for r in rows}
        if name == "suffix-array dedup":
            assert len(got) == len(rows) and sum(len(r.text or "") for r in got) < sum(len(r[1] or "") for r in rows)
        if name == "benchmark decontamination":
            assert len(got) == len(rows) - 1 and all(r.doc_id != 3 for r in got)
        if name == "minhash near-dedup":
            assert len(got) == len(rows) - 1
        assert stage(spark, df.limit(0), str(tmp_path)).collect() == []


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp

    from varloom.llm import decontaminate
    from varloom.llm.common import read_table, written

    docs, columns = read_table(spark, SF, "documents"), None
    steps = {}
    for name, stage in cp.STAGES:
        columns = columns or docs.columns
        before = docs
        docs = written(stage(spark, docs, SF), "test-stage")
        steps[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = steps["quality rules"]
    kept = {r["doc_id"]: r for r in after}
    for r in before:
        want = plain_quality(r["text"])
        assert (None if want is None else (want, len(want))) == ((kept[r["doc_id"]]["text"], kept[r["doc_id"]]["n_chars"]) if r["doc_id"] in kept else None)
    assert 0 < len(after) < len(before)
    before, after = steps["minhash near-dedup"]
    p = minhash.MinHashParams()
    counts, n = minhash.document_frequency(spark.createDataFrame([(r["text"],) for r in before], "text string"), "text", p)
    groups = classes_by_brute_force([(r["doc_id"], r["text"]) for r in before], minhash.idf_table(counts, n), p)
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in groups})
    before, after = steps["suffix-array dedup"]
    want = {d: h for d, *_, h in brute_repeats([(r["doc_id"], r["text"]) for r in before])}
    exact = [r for r in after if hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]]]
    assert len(exact) >= len(after) - 2  # a character cut in two goes whole
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = steps["benchmark decontamination"]
    items = read_table(spark, SF, "benchmark").collect()
    index = decontaminate.Items([r.item_id for r in items], [r.text for r in items], decontaminate.LeakParams())
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    fold = lambda t: bytes(decontaminate._FOLD[np.frombuffer(t.encode(), np.uint8)])
    holds = lambda t: any(nearest(fold(i.text), fold(t)) <= index.edits[k] for k, i in enumerate(items))
    assert gone == {r["doc_id"] for r in before if holds(r["text"])} and gone
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in steps["sentencepiece"][1])
    assert sorted(r.doc_id for r in cp.run(spark, SF).collect()) == sorted(r["doc_id"] for r in steps["sentencepiece"][1])
