import random

from pyspark.sql import functions as F

from varloom.operators import intervals, neighborhoods


def fifo(variants, regions):
    """Front-of-queue walk over sorted variants of one contig."""
    queue, out = list(regions), {}
    for i, s, e in variants:
        while queue and s > queue[0][1]:
            queue.pop(0)
        out[i] = bool(queue) and queue[0][0] <= s and e <= queue[0][1]
    return out


def test_first_live_region_is_the_fifo(spark):
    rng = random.Random(3)
    for width in (7, 1 << 20):
        regions = sorted((s := rng.randrange(400), s + rng.randrange(1, 60)) for _ in range(25))
        variants = sorted((rng.randrange(450), rng.randrange(1, 15)) for _ in range(80))
        variants = [(i, s, s + n) for i, (s, n) in enumerate(variants)]
        v = spark.createDataFrame([("c", *x) for x in variants] + [("other", 999, 1, 2)], "chrom string, ordinal long, start long, end long")
        r = spark.createDataFrame([("c", s, e, k) for k, (s, e) in enumerate(regions)], "chrom string, start long, end long, ordinal long")
        got = {x.ordinal: x.in_region for x in intervals.first_live_region(v, r, width=width).collect()}
        assert got == fifo(variants, regions) | {999: False}


def test_only_the_second_overlapping_region_holds_it(spark):
    r = spark.createDataFrame([("c", 0, 50, 0), ("c", 20, 100, 1)], "chrom string, start long, end long, ordinal long")
    v = spark.createDataFrame([("c", 0, 30, 60), ("c", 1, 50, 51), ("c", 2, 51, 60)], "chrom string, ordinal long, start long, end long")
    assert {x.ordinal: x.in_region for x in intervals.first_live_region(v, r).collect()} == {0: False, 1: False, 2: True}


def test_range_join_finds_each_pair_once(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), i, rng.randrange(200)) for i in range(60)]
    spans = [(rng.choice("ab"), k, s := rng.randrange(200), s + rng.randrange(60)) for k in range(60)]
    p = spark.createDataFrame(points, "chrom string, i long, at long")
    s = spark.createDataFrame(spans, "chrom string, k long, s long, e long")
    got = intervals.range_join(p, s, "chrom", F.col("at"), "s", "e", (F.col("s") < F.col("at")) & (F.col("at") < F.col("e")), 16)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, k) for c, i, a in points for d, k, x, y in spans if c == d and x < a < y)
    assert sorted((r.i, r.k) for r in got.select("i", "k").collect()) == want


def test_lookup_takes_the_first_interval(spark):
    p = spark.createDataFrame([(0, "x", 5), (1, "x", 10), (2, "x", 20), (3, "y", 5)], "id long, chrom string, start long")
    iv = spark.createDataFrame([("x", 4, 12, "b"), ("x", 0, 10, "a"), ("x", 4, 8, "c")], "chrom string, start long, end long, v string")
    iv = iv.withColumnsRenamed({"v": "ploidy"})
    got = intervals.interval_lookup(p.withColumnRenamed("start", "at"), iv, ["id"], "chrom", "at", "ploidy", 4)
    assert {r.id: r.ploidy for r in got.collect()} == {0: "a", 1: "b", 2: None, 3: None}


def test_genome_split_and_contigs(spark):
    c = spark.createDataFrame([("a", 25), ("b", 10), ("z", 0)], "chrom string, length long")
    assert sorted(map(tuple, intervals.split_genome(c, 10).collect())) == [("a", 0, 10), ("a", 10, 20), ("a", 20, 25), ("b", 0, 10)]
    bed = spark.createDataFrame([("a", 1, 2, 0), ("q", 1, 2, 1)], "chrom string, start long, end long, ordinal long")
    assert [r.chrom for r in intervals.bed_regions(c, bed).collect()] == ["a"]


def test_neighborhoods_walk(spark):
    rng = random.Random(2)
    rows = sorted((rng.choice("ab"), rng.randrange(3000), rng.randrange(1, 90)) for _ in range(150))
    rows = [(c, s, s + n, i) for i, (c, s, n) in enumerate(rows)]
    want, last, far, ne = {}, None, 0, 0
    for c, s, e, i in rows:
        if c != last or far + 20 < s:
            ne, far = s, e
        last, far = c, max(far, e)
        want[i] = ne
    df = spark.createDataFrame(rows, "chrom string, start long, end long, ordinal long")
    assert {r.ordinal: r.ne for r in neighborhoods.neighborhoods(df, 20).collect()} == want
    for width in (16, 100, 10_000):
        assert {r.ordinal: r.ne for r in neighborhoods.binned_neighborhoods(df, 20, width).collect()} == want


def test_edges(spark):
    df = spark.createDataFrame([("c", 0, 10, 20, 1), ("c", 0, 15, 30, 2), ("c", 0, 20, 25, 3)], "chrom string, ne long, start long, end long, node int")
    assert sorted((r.src, r.dst) for r in neighborhoods.edges(df, with_anchors=False).collect()) == [(1, 3)]
    full = sorted((r.src, r.dst) for r in neighborhoods.edges(df).collect())
    assert full == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 3), (1, 4), (2, 4), (3, 4)]


def test_size_join_makes_no_pairs_of_far_sizes(spark):
    """All pairs of a ratio of 0.9 or more, its very border too, and none under 0.7; a key's two tables are not multiplied."""
    sizes = [0, 1, 2, 9, 10, -10, 81, 90, 99, 100, 110, 900, 999, 1000, 1110, 5 * 10**8, 10**9, 123_456_789]
    a = spark.createDataFrame([(k, s) for k in (1, 2) for s in sizes], "k int, x long")
    b = spark.createDataFrame([(1, s) for s in sizes], "k int, y long")
    got = sorted(tuple(r) for r in intervals.size_join(a, b, "k", "x", "y", 0.9).select("x", "y").collect())
    ratio = lambda x, y: max(min(abs(x), abs(y)), 1) / max(abs(x), abs(y), 1)
    pairs = [(x, y) for x in sizes for y in sizes]
    assert {p for p in pairs if ratio(*p) >= 0.9} <= set(got) and len(got) == len(set(got))
    assert all(ratio(*p) > 0.7 for p in got) and len(got) < len(pairs) / 3
