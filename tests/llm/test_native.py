"""URL filter, chat rotation, quality rules and sharding: defined cases and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from varloom.llm import chat, components, oracles, quality, queries, sharding, url_filter
from varloom.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- URL filter


def page(i, url, html=None):
    return (i, url, html, "x")


def canonical(to):
    return f'<html><head><link href="{to}" rel="canonical"></head></html>'


def test_rules_follow_the_contract(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q#f", "http://www.example.com/en/2", "http://m.example.com/en/3", "http://x.net/es/1", "http://x.net/de/1", "http://com", "http://com/", "nothing", None, "http://xnet/es/", "http://h.net?a/es/", "HTTP://Ünet.COM/A", "http://evilexample.com/en/"]
    df = spark.createDataFrame([page(i, u) for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, URL_RULES).collect()}
    assert got == {
        0: ("a.com", "/x", "com/", "allow"), 1: ("example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        3: ("m.example.com", "/en/3", "example.com/en/", "block"), 4: ("x.net", "/es/1", "net/es/", "block"), 5: ("x.net", "/de/1", None, "allow"), 6: ("com", "", None, "allow"),
        7: ("com", "/", "com/", "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("xnet", "/es/", None, "allow"), 11: ("h.net", "", None, "allow"),
        12: ("Ünet.com", "/A", "com/", "allow"), 13: ("evilexample.com", "/en/", "com/", "allow"),
    }


def test_blocks_follow_aliases_and_allow_goes_first(spark):
    pages = [
        page(0, "http://a.org/1", canonical("http://b.net/es/x")),  # alias of a blocked address
        page(1, "http://a.org/2", '<meta http-equiv="refresh" content="0; url=/3">'), page(2, "https://a.org/3#top", canonical("//c.net/fr/y?z=1&amp;k=2")),
        page(3, "http://d.org/1", canonical("http://b.net/es/q")), page(4, "http://d.org/1?x", canonical("https://e.com/ok")), page(5, "http://d.org/2", "<link rel='canonical' href='http://d.org/1?x'>"),
        page(6, "http://b.net/es/x", canonical("http://e.com/ok2")), page(7, "http://free.org/", None), page(8, "http://f.org/a/b", '<meta http-equiv=refresh content="5;URL=c">'), page(9, "http://f.org/a/c", None),
        page(0, "http://a.org/1", canonical("http://b.net/es/x")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    redirects = spark.createDataFrame([("http://d.org/1", "http://d.org/1"), ("http://g.org/", "http://x.net/es/"), ("http://f.org/a/c", "http://g.org/"), (None, "http://q.org/")], "src string, dst string")
    got = sorted((r.page_id, r.verdict) for r in url_filter.judge_urls(df, URL_RULES, redirects).collect())
    # 0's class holds b.net/es/x, which itself is an alias of the allowed e.com/ok2
    assert got == [(0, "allow"), (0, "allow"), (1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "block"), (7, "allow"), (8, "block"), (9, "block")]
    assert rows(url_filter.judge_urls(df.limit(0), URL_RULES)) == []


def test_every_link_of_a_page_is_an_edge(spark):
    refresh = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    pages = [
        page(0, "http://a.org/1", canonical("http://a.org/1") + refresh("http://b.net/es/x")),  # self-canonical, redirects to a blocked address
        page(1, "http://a.org/2", canonical("http://b.net/es/y") + refresh("http://e.com/ok")),
        page(2, "http://a.org/3", canonical("http://a.org/3") + canonical("http://b.net/fr/z")),
        page(3, "http://a.org/4", refresh("http://a.org/4") + refresh("http://b.net/fr/q?a=1&amp;b=2")), page(4, "http://a.org/5", canonical("http://a.org/5") + canonical("") + refresh("")), page(5, "http://a.org/6", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = {r.page_id: (r.verdict, r.class_id) for r in url_filter.judge_urls(df, URL_RULES).collect()}
    assert got == {0: ("block", "a.org/1"), 1: ("allow", "a.org/2"), 2: ("block", "a.org/3"), 3: ("block", "a.org/4"), 4: ("allow", None), 5: ("allow", None)}


def test_relative_targets_are_resolved(spark):
    base = "http://a.org/b/c/d?q"
    want = {
        "g": "a.org/b/c/g", "./g": "a.org/b/c/g", "g/.": "a.org/b/c/g/", ".": "a.org/b/c/", "..": "a.org/b/", "../g": "a.org/b/g", "../../g?y#s": "a.org/g?y", "../../../g": "a.org/g", "/./g/../h": "a.org/h",
        "g;x=1/../y": "a.org/b/c/y", "g?y/../x": "a.org/b/c/g?y/../x", "?x=1": "a.org/b/c/d?x=1", "?to=http://e.com/": "a.org/b/c/d?to=http://e.com/", "#s": "a.org/b/c/d?q", "..g": "a.org/b/c/..g", "g//h/": "a.org/b/c/g//h/",
        "//e.com/x": "e.com/x", "https://e.com/x/../y": "e.com/x/../y",
    }
    for to, dst in want.items():
        df = spark.createDataFrame([page(0, base, canonical(to))], "page_id long, url string, html string, host string")
        assert [(r.src, r.dst) for r in url_filter.link_edges(df).collect()] == [("a.org/b/c/d?q", dst)], to


def test_components_against_union_find(spark):
    rng = random.Random(5)
    for n, m in ((40, 25), (60, 80), (30, 0)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200 + i) for i in range(30)] + [(None, 3), (7, 7)]
        parent = {}
        find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
        for a, b in pairs:
            if a is not None and a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        got = dict(rows(components.connected_components(spark.createDataFrame(pairs, "src long, dst long"))))
        assert got == {x: find(x) for x in parent}


def test_a_machine_local_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from varloom.llm import common

    conf = {}
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(far)
    conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert common.shared_dir(far) == "hdfs://x/y"


# --- queries beside their SQL


@pytest.fixture(scope="module")
def duck():
    import os

    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(oracles.oracle_sql()[name]).df()
    plain = lambda frame: sorted((tuple(None if x is None or x != x else str(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


# --- chat


def spoken(turns, who, context=("system",)):
    text, spans = "", []
    for role, words in turns:
        head = "assistant" if role == who else role if role in context else "user name=" + re.sub(r"[^\w.-]+", "_", role)
        text += f"<|im_start|>{head}\n"
        at = len(text)
        text += f"{words}<|im_end|>"
        if role == who:
            spans.append((at, len(text)))
        text += "\n"
    return text, spans


def test_rotation(spark):
    talks = {1: [("system", "s"), ("ann", "hi é😀"), ("bob smith", ""), ("ann", "bye\n")], 2: [("bob", "x"), ("bob", "x")], 3: [("system", "only")]}
    turns = [(c, t, r, w, "p") for c, ms in talks.items() for t, (r, w) in enumerate(ms)] + [(4, 0, None, None, "p"), (4, None, "z", "first", "p"), (None, 0, "o", "1", "p"), (None, 0, "o", "2", "p")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, perspective string")
    out = chat.rotate(df)
    no_python(out)
    got = {(r.conv_id, r.perspective): (r.text, [tuple(s) for s in r.mask]) for r in out.collect() if r.conv_id is not None}
    talks[4] = [("z", "first"), ("unknown", "")]
    want = {(c, who): spoken(ms, who) for c, ms in talks.items() for who in {r for r, _ in ms} - {"system"}}
    assert got == want
    assert sorted(r.text for r in out.collect() if r.conv_id is None) == [spoken([("o", x)], "o")[0] for x in "12"]
    assert rows(chat.rotate(df.limit(0))) == []


# --- quality


def word_figures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, cover = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {j for i in at for j in (i, i + 1, i + 2)}
    lines, dup, known = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in known
            known.add(line)
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover), failed


def test_quality_figures_against_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "  \n\t", "a b a b a b a b", " x y z"] + ["".join(rng.choice(["a", "b", "é ", " ", "\n", "#", "ab ", "😀", "\u0085", "\x0b"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    texts.append(" ".join(f"w{rng.randrange(3000)}" for _ in range(20_000)))
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string, kept string")
    out = quality.judge(df)
    no_python(out)
    got = out.select("doc_id", "quality.*").collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        want = word_figures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.doc_id
        assert not (r.kept and r.base_failed)
    assert rows(quality.judge(df.limit(0))) == []


def test_line_rules_clean_first(spark):
    rng = random.Random(1)
    body = [" ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(10)) + "." for _ in range(8)]
    junk = ["Home | About | Contact | Help", "Home", "All rights reserved.", "no end mark in this line of words"]
    good = "\n".join([body[0], "", *body[1:3], "Heading", *junk, *body[3:]])
    bad = "\n".join([*body[:6], *("and another line without any end at all " + "x" * 90 + str(i) for i in range(9))])
    df = spark.createDataFrame([(1, good, 0, "a"), (2, bad, 0, "b"), (3, "too short.", 0, "c"), (4, None, 0, None)], "doc_id long, text string, n_chars long, quality string")
    (r,) = quality.clean(df).collect()
    assert (r.doc_id, r.text, r.quality) == (1, "\n".join([body[0], "", *body[1:3], "Heading", *body[3:]]), "a")
    assert r.n_chars == len(r.text)
    assert quality.clean(df).columns == df.columns


# --- sharding


def brute_shards(items, limit):
    """Recursive splitting of (hash, bytes)."""
    out = {}

    def split(prefix, depth, part):
        if sum(b for _, b in part) <= limit or len({h for h, _ in part}) == 1:
            for h, _ in part:
                out[h] = (prefix, depth)
            return
        for bit in (0, 1):
            sub = [x for x in part if x[0] >> (sharding.HASH_BITS - depth - 1) & 1 == bit]
            if sub:
                split(prefix * 2 + bit, depth + 1, sub)

    if items:
        split(0, 0, items)
    return out


@pytest.mark.parametrize("limit", [10_000, 400, 150])
def test_extendible_hashing_against_splitting(spark, limit):
    rng = random.Random(limit)
    docs = [(i, "é" * rng.randrange(60), "z", i) for i in range(150)] + [(None, "abc", "z", 1), (777, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string, bytes long")
    out = sharding.assign_shards(df, limit=limit)
    no_python(out)
    hashed = {r.doc_id: r.h for r in df.select("doc_id", sharding.key_hash(F.col("doc_id")).alias("h")).collect()}
    want = brute_shards([(hashed[d], len((t or "").encode())) for d, t, *_ in docs], limit)
    got = out.collect()
    assert {r.doc_id: (r.shard.prefix, r.shard.depth) for r in got} == {d: want[hashed[d]] for d, *_ in docs}
    assert all(r.shard.shard_bytes <= limit for r in got)
    assert rows(sharding.assign_shards(df.limit(0), limit=limit)) == []


def test_equal_keys_overflow_to_pages(spark):
    df = spark.createDataFrame([(1, "x" * 40)] * 50 + [(2, "y" * 500), (2, "y" * 30)], "doc_id long, text string")
    got = sharding.assign_shards(df, limit=200).collect()
    size = {}
    for r in got:
        name = (r.shard.prefix, r.shard.depth, r.shard.page)
        size[name] = size.get(name, []) + [r.shard.bytes]
    assert sum(map(len, size.values())) == 52
    assert all(sum(x) <= 200 or len(x) == 1 for x in size.values())
    assert all(r.shard.shard_bytes == sum(size[r.shard.prefix, r.shard.depth, r.shard.page]) for r in got)


def test_roll_up_in_steps(spark, monkeypatch):
    """More depths than one roll-up covers, with one cell that needs many bits."""
    monkeypatch.setattr(sharding, "_ROLL", 2)
    rng = random.Random(2)
    hashes = [rng.randrange(1 << 60) for _ in range(60)] + [(5 << 50) + k for k in range(40)]
    items = [(h, rng.randrange(1, 90)) for h in hashes]
    sized = spark.createDataFrame(items, "h long, bytes long")
    for limit in (120, 1000, 1 << 20):
        cells, bits = sharding.directory(sized, limit)
        found = {r.cell: (r.prefix, r.depth) for r in cells.collect()}
        want = brute_shards(items, limit)
        assert {h: found[h >> (60 - bits)] for h in hashes} == want
