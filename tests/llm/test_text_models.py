"""Language ID, token files, SentencePiece and decontamination."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from varloom.llm import decontaminate, langid, sentencepiece_viterbi, token_files
from varloom.llm.common import new_path, text_buffers
from varloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "  a", "a  b   c    d ", " " * 40 + "x", "a" * 3000, "hello\nworld\t\tfoo  ", "日本語 한국어", "😀😀 x▁y ▁▁z", "<|endoftext|> a<|endoftext|>b", "<s> <unk> <0x41>", "\x00\x01 \x1c \x85x", "don't we'll 123 4.5 ===---", " x   y", "a\r\n b"]


# --- token files


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    file = tokenizer_path("byte_bpe_50k.json")
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["the ", "Ab", " ", "\n", "é", "'s", "12", "  ", "　"]) for _ in range(rng.randrange(200))) for _ in range(150)]
    docs = [(i * 7 % 1000 if i % 50 else None, t, "x") for i, t in enumerate(texts)] + [(14, "again", "x"), (14, "again", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, start string").repartition(5)
    path = new_path(spark, "test-tokens")
    manifest = token_files.write_tokens(df, path, file)
    got = [tuple(r) for r in token_files.read_tokens(spark, path, manifest).collect()]
    tok, start, want = Tokenizer.from_file(file), 0, []
    for d, t, _ in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    one = manifest.collect()[0]
    assert token_files.TokenShard(path, one.file).ids(0, 3).dtype == np.dtype("<u2")


def test_token_files_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    path = new_path(spark, "test-none")
    manifest = token_files.write_tokens(df, path, tokenizer_path("byte_bpe_50k.json"))
    assert token_files.read_tokens(spark, path, manifest).collect() == []


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def sample_texts():
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()[:200] + pq.read_table(f"{SF}/pages.parquet", columns=["html"])["html"].to_pylist()[:15]


def test_viterbi_gives_the_librarys_ids(library):
    codec = sentencepiece_viterbi.codec(tokenizer_path("piece_bpe_32k.model"))
    texts = [t for t in ODD if t is not None] + sample_texts()
    ids, lens = codec.encode(texts)
    cut = np.concatenate([[0], np.cumsum(lens)])
    data, off = codec.decode(ids, lens)
    for k, (text, want) in enumerate(zip(texts, library.encode(texts), strict=True)):
        assert ids[cut[k] : cut[k + 1]].tolist() == want, text[:50]
        assert bytes(data[off[k] : off[k + 1]]).decode() == text.replace("▁", " ") == library.decode(want)


def test_viterbi_on_random_letters(library):
    rng = random.Random(4)
    codec = sentencepiece_viterbi.codec(tokenizer_path("piece_bpe_32k.model"))
    texts = ["".join(rng.choice("abcdetinos  ") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choice("▁ \n") for _ in range(rng.randrange(50))) for _ in range(50)]
    ids, lens = codec.encode(texts)
    cut = np.concatenate([[0], np.cumsum(lens)])
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == library.encode(texts)


def test_sentencepiece_frames(spark, library):
    file = tokenizer_path("piece_bpe_32k.model")
    docs = [(i, t, [9]) for i, t in enumerate(ODD)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string, ids array<int>")
    out = sentencepiece_viterbi.encode(df, file, check="ok")
    got = out.collect()
    assert len(got) == len(docs) and all(r.ids == library.encode(ODD[r.doc_id] or "") and r.ok for r in got)
    back = sentencepiece_viterbi.decode(out.drop("text"), file).collect()
    assert all(r.text == (ODD[r.doc_id] or "").replace("▁", " ") for r in back)
    rows = sentencepiece_viterbi.digest(df, file).collect()
    assert all(r.n_tokens == len(library.encode(ODD[r.doc_id] or "")) and r.round_trip for r in rows)
    assert sentencepiece_viterbi.digest(df.limit(0), file).collect() == []


# --- decontamination


def sellers(pattern, text):
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for c in text:
        new = [0]
        for j, x in enumerate(pattern, 1):
            new.append(min(column[j - 1] + (x != c), column[j] + 1, new[-1] + 1))
        column, best = new, min(best, new[-1])
    return best


def test_leaks_against_sellers():
    import pyarrow.parquet as pq

    rng = random.Random(6)
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    index = decontaminate.Items([x["item_id"] for x in items], [x["text"] for x in items], decontaminate.LeakParams())
    fold = lambda s: bytes(decontaminate._FOLD[np.frombuffer(s.encode(), np.uint8)])
    hits = 0
    for _ in range(40):
        k = rng.randrange(len(items))
        s, e = list(items[k]["text"]), int(index.edits[k])
        for _ in range(rng.randrange(int(1.8 * e) + 1)):
            i = rng.randrange(len(s))
            s[i : i + rng.randrange(2)] = rng.choice(["", "a", "Z", " "])
        text = "x" * rng.choice([0, 3, 400]) + "".join(s) + " tail" * rng.choice([0, 1, 60])
        data, off = text_buffers(pa.array(["before", text, "", "after"]))
        found = [x for d, i, x, _ in index.leaks(data, off) if (d, i) == (1, k)]
        want = sellers(fold(items[k]["text"]), fold(text))
        hits += want <= e
        assert (min(found) if found else None) == (want if want <= e else None)
    assert 10 < hits < 40


def test_items_beyond_18_bits_are_found_under_their_own_number():
    texts = [hashlib.md5(str(k).encode()).hexdigest()[:12] for k in range((1 << 18) + 10)]
    items = decontaminate.Items(list(range(len(texts))), texts, decontaminate.LeakParams())
    docs = ["nothing", f"x {texts[-1]} y", f"{texts[5]} {texts[1 << 18]}"]
    raw = [d.encode() for d in docs]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    assert [(d, k, x) for d, k, x, _ in items.leaks(data, off)] == [(1, len(texts) - 1, 0), (2, 5, 0), (2, 1 << 18, 0)]


def test_long_texts_are_read_in_pieces():
    item = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest at night"
    items = decontaminate.Items([[5], [6]], [item, "tiny 7"], decontaminate.LeakParams())
    for at in (0, 990, 1000, 1010, 1080, 2500, 4909):
        raw = bytearray(b"z" * 5000)
        raw[at : at + len(item)] = item.encode()
        raw[3000:3006] = b"tiny 7"
        data, off = np.frombuffer(b"ab" + bytes(raw) + item.encode(), np.uint8), np.array([0, 2, 5002, 5002 + len(item)])
        got = items.leaks(data, off, piece=1000)
        assert (1, 0, 0, at + len(item)) in got and (1, 1, 0, 3006) in got and (2, 0, 0, len(item)) in got and {g[0] for g in got} == {1, 2}


def test_an_item_far_into_a_text():
    item = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest at night"
    items = decontaminate.Items([[5]], [item], decontaminate.LeakParams())
    data = np.full(70_000_100, ord("y"), np.uint8)
    data[70_000_000 : 70_000_000 + len(item)] = np.frombuffer(item.encode(), np.uint8)
    assert items.leaks(data, np.array([0, len(data)])) == [(0, 0, 0, 70_000_000 + len(item))]


def test_find_and_drop_leaks(spark):
    item = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest at night"
    docs = [(1, "A " + item.upper().replace(" ", "\n") + " b", "k"), (2, item[:60], "k"), (3, None, None), (4, "", "k"), (None, item, "k"), (6, "x" * 100_000 + item[:40] + "zz" + item[41:], "k"), (7, "a tiny b", "k"), (7, "a tiny b", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(10, item), (11, "tiny"), (12, None), (13, ""), (14, "never there at all in these documents of mine, I say"), (15, "tiny")], "item_id long, text string")
    want = [(None, [10]), (1, [10]), (2, []), (3, []), (4, []), (6, [10]), (7, [11, 15]), (7, [11, 15])]
    for part in (4 << 20, 60):  # one part, then several passes
        got = decontaminate.find_leaks(df, bench, p=decontaminate.LeakParams(part_bytes=part)).collect()
        assert sorted(((r.doc_id, sorted({x.item_id for x in r.leaks})) for r in got), key=str) == sorted(want, key=str)
        kept = decontaminate.drop_leaks(df, bench, p=decontaminate.LeakParams(part_bytes=part))
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.drop_leaks(df.limit(0), bench).collect() == []
    assert decontaminate.find_leaks(df.limit(0), bench).collect() == []
    assert all(not r.leaks for r in decontaminate.find_leaks(df, bench.limit(0)).collect())


# --- language ID


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, table = langid.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").toPandas()
    got = [names[k] for k in langid._score(held["text"].tolist(), table).argmax(axis=1)]
    assert np.mean([a == b for a, b in zip(got, held["lang"], strict=True)]) > 0.98


def plain_identify(docs, pages, p):
    """langid from its definition, with dictionaries."""
    import html
    import math
    import re
    from collections import Counter, defaultdict

    def grams(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        return Counter(((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(low) - 2))

    counts = defaultdict(Counter)
    for text, lang in docs:
        if lang and text is not None:
            counts[lang].update(grams(text))
    names = sorted(counts)
    total = {n: sum(counts[n].values()) + p.smooth * langid.FEATURES for n in names}
    rows = []
    for key, url, page in pages:
        seen = html.unescape(re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", page)) if page else ""
        g = grams(seen)
        s = [p.temper * sum(c * math.log((counts[n][f] + p.smooth) / total[n]) for f, c in g.items()) for n in names]
        s = [x - max(s) for x in s]
        e = [math.exp(x) for x in s]
        host = (re.search(r"://([^/?#]*)", url or "") or [None, ""])[1].lower()
        domain = (re.search(r"([^.]+\.[^.]+)$", host) or [None, ""])[1]
        suffix = host.split(".")[-1] if re.fullmatch("[a-z]{2}", host.split(".")[-1]) else ""
        said = (re.search(r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})(?![a-zA-Z])", page or "") or [None, ""])[1].lower()
        rows.append((key, host, domain, suffix, said, s, [x / sum(e) for x in e]))

    def sums(k):
        out = defaultdict(lambda: [0.0] * len(names))
        for r in rows:
            out[r[k]] = [a + b for a, b in zip(out[r[k]], r[6], strict=True)]
        return out

    by_host, by_domain, by_suffix, by_said = (sums(k) for k in (1, 2, 3, 4))
    whole = [sum(r[6][i] for r in rows) for i in range(len(names))]
    prior = [(x + 1) / (sum(whole) + len(names)) for x in whole]
    out = []
    for key, host, domain, suffix, said, s, q in rows:
        f = []
        for i in range(len(names)):
            near = (max(by_domain[domain][i] - q[i], 0) + p.domain_weight * prior[i]) / (max(sum(by_domain[domain]) - 1, 0) + p.domain_weight)
            near = (max(by_host[host][i] - q[i], 0) + p.host_weight * near) / (max(sum(by_host[host]) - 1, 0) + p.host_weight)
            v = s[i] + math.log(near)
            for table, own in ((by_said, said), (by_suffix, suffix)):
                if own:
                    n = len([x for x in table if x]) + 1
                    v += math.log((table[own][i] + p.table_smooth) / (whole[i] + p.table_smooth * n))
            f.append(v)
        best = f.index(max(f))
        out.append((key, names[best], 1 / sum(math.exp(x - max(f)) for x in f), names[q.index(max(q))], said, host))
    return out


def test_language_id_against_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(9000, None, None), (9001, "http://a.example.de/x", ""), (9002, "http://a.example.de/x", "<html lang='FR-fr'><p>une &eacute;t&eacute; &amp; un hiver"), (9003, "nothing", "<html lang=q1>x")], "page_id long, url string, html string")
    pages = pages.unionByName(odd)
    want = plain_identify([(r.text, r.lang) for r in docs.collect()], [tuple(r) for r in pages.collect()], langid.LangParams())
    got = {r.page_id: r for r in langid.identify(pages, langid.train(docs)).collect()}
    assert len(got) == len(want)
    for key, lang, prob, text_lang, said, host in want:
        r = got[key]
        assert (r.lang, r.text_lang, r.declared, r.host) == (lang, text_lang, said, host) and r.prob == pytest.approx(prob, rel=1e-6)


def test_long_pages_score_as_short_ones():
    rng = np.random.default_rng(1)
    model = rng.random((langid.FEATURES, 3))
    text = "".join(chr(c) for c in rng.integers(97, 123, 100_000))
    one = langid._score(["ab", text, "", "xyz"], model)
    feature, _ = langid.trigrams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert np.allclose(one[1], model[feature].sum(axis=0)) and not one[0].any() and not one[2].any() and one[3].all()


def test_evidence_fusion(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    text = {r.lang: r.text for r in docs.where("length(text) > 2000").dropDuplicates(["lang"]).collect()}
    page = lambda lang, words: f"<html{f' lang={chr(34)}{lang}-X{chr(34)}' if lang else ''}><script>var x</script><p>{words}</p></html>"
    pages = [(i, "http://a.example.de/x", page("de", text["de"])) for i in range(30)] + [(40, "http://a.example.de/y", page("de", "")), (41, "http://new.example.de/", None), (42, None, page("fr", text["fr"])), (43, "http://b.org/", page("", text["es"])), (44, "http://a.example.de/z", page("de", text["fr"])), (44, "http://a.example.de/z", page("de", text["fr"]))]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in langid.identify(df, model).collect()}
    assert len(got) == len(pages) - 1
    assert [got[k].lang for k in (0, 40, 41, 42, 43, 44)] == ["de", "de", "de", "fr", "es", "fr"]
    assert all(0 < r.prob <= 1 for r in got.values()) and got[42].host == "" and got[43].declared == ""
    assert langid.identify(df.limit(0), model).collect() == []
    none = langid.train(docs.limit(0))
    assert {r.lang for r in langid.identify(df, none).collect()} == {None}


# --- long words


@pytest.mark.parametrize("kind", ["letters", "pieces", "cjk", "runs", "periods", "mixed"])
def test_words_of_any_length_get_the_librarys_ids(kind):
    import public_tokenizers
    import sentencepiece

    rng, file = random.Random(kind), public_tokenizers.path("piece_bpe_32k.model")
    make = {
        "letters": lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)),
        "pieces": lambda n: "".join(rng.choice(["the", "ing", "tion", "er", "house", "anti", "of", "X"]) for _ in range(n // 3)),
        "cjk": lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n)),
        "runs": lambda n: "".join(rng.choice("a=0-x") * rng.randint(1, 400) for _ in range(max(1, n // 200))),
        "periods": lambda n: "".join(rng.choice(["ab", "abc", "0123456789", "-=", "han"]) * rng.randint(1, 150) for _ in range(max(1, n // 200))),
        "mixed": lambda n: " ".join("".join(chr(rng.choice([97, 101, 233, 0x4E00, 0x1F600, 0x2581])) for _ in range(rng.randint(1, 400))) for _ in range(3)),
    }[kind]
    texts = [make(n) for n in (160, 161, 200, 303, 1000, 3001)]
    ids, lens = sentencepiece_viterbi.codec(file).encode(texts)
    want = sentencepiece.SentencePieceProcessor(model_file=file).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == want


def test_a_megabyte_without_a_space_takes_seconds():
    import time

    import public_tokenizers
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.perf_counter()
    ids, _ = sentencepiece_viterbi.codec(file).encode([text])
    assert time.perf_counter() - began < 20
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=file).encode(text)


def test_decoding_and_powers_take_little_memory():
    """Texts are decoded some at a time, and powers of long texts go when a group or partition has ended."""
    import tracemalloc

    from varloom.llm import common

    tool = sentencepiece_viterbi.codec(tokenizer_path("piece_bpe_32k.model"))
    texts = ["plain words, again and again. " * 400] * 300 + ["", None, " x  y "]
    ids, lens = tool.encode(texts)
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    off = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
    tracemalloc.start()
    same, back = tool.round_trip(ids, lens, data, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(same) and back.tolist() == off.tolist()
    assert peak < 4 * len(data)  # an index of all bytes takes 16 a byte
    common._powers(3 << 20)
    common.release()
    assert len(common._pow) == len(common._inv) == 1 << 20
    assert (common._powers(3 << 20)[0] * common._powers(3 << 20)[1] == 1).all()
