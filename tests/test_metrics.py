import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varloom.functions import metrics, sequences, vectors
from varloom.operators import cluster

# ref, alt, state, gq, sq
GOLDEN = [
    (0, 0, "Non", 0, 4.7712), (1, 0, "Ref", 3.4635, 1.7624), (0, 1, "Hom", 2.3736, 31.7638), (4, 0, "Ref", 13.8541, 0.1752),
    (0, 4, "Hom", 9.4944, 100), (0, 5, "Hom", 11.8680, 100), (3, 3, "Het", 21.5064, 71.8509), (7, 2, "Het", 30.5625, 30.5664),
    (2, 7, "Het", 2.4696, 100), (2, 8, "Hom", 6.4424, 100), (10, 0, "Ref", 30.0595, 0.0043), (0, 10, "Hom", 25.5273, 100),
    (15, 15, "Het", 66.5546, 100), (18, 2, "Ref", 0.1278, 2.9469), (27, 3, "Ref", 0.1917, 2.9155), (3, 27, "Hom", 47.9545, 100),
    (30, 0, "Ref", 90.1786, 0.0), (0, 30, "Hom", 76.5818, 100), (60, 40, "Het", 100, 100), (61, 40, "Het", 100, 100),
]


def test_genotype_likelihoods(spark):
    df = spark.createDataFrame([g[:2] for g in GOLDEN], "r int, a int")
    r, a = F.col("r"), F.col("a")
    got = df.select(metrics.genotyper(r, a).alias("s"), metrics.genotype_quals(r, a).alias("q")).collect()
    for row, (ref, alt, state, gq, sq) in zip(got, GOLDEN, strict=True):
        assert row.s == state == cluster.state_of(ref, alt)
        assert row.q.gq == pytest.approx(gq, abs=1e-3)
        assert row.q.sq == pytest.approx(sq, abs=1e-3)


@pytest.mark.parametrize(
    ("seq", "k", "want"),
    [
        ("ACGTACGTAC", 3, {9: 2, 28: 2, 39: 2, 50: 2}), ("acgtN", 2, {2: 1, 7: 1, 9: 1, 12: 1}), ("AC", 3, {}), ("AAAAAAAA", 4, {0: 5}),
        ("GATTACA", 1, {0: 3, 1: 1, 2: 1, 3: 2}), ("GATTACAGATTACA", 4, {19: 1, 33: 1, 60: 2, 79: 2, 132: 1, 200: 2, 242: 2}), ("", 2, {}),
    ],
)
def test_kmers(spark, seq, k, want):
    got = sequences.kmer_counts(seq.encode(), k)
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == want
    assert (sequences.kmer_counts(seq.encode(), k, negative=True) == -got).all()
    df = spark.createDataFrame([(seq,)], "s string")
    row = df.select(sequences.kmer_udf(k)("s").alias("u"), sequences.kmer_counts_sql(F.col("s"), k).alias("m")).first()
    assert row.u == got.tolist()
    assert row.m == want


@pytest.mark.parametrize(("seq", "m", "want"), [("AAAAAAAGGC", 5, "AAAAGGC"), ("AAAAAAAGGC", 4, "AAAGGC"), ("AAAAAAAGGC", 2, "AGC"), ("AAAAAAAGGC", 1, "AGC"), ("AAAA", 4, "AAA"), ("AAAA", 5, "AAAA"), ("aAAa", 2, "aAa"), ("", 3, ""), ("AAAA", 0, "AAAA")])
def test_homopolymers(spark, seq, m, want):
    df = spark.createDataFrame([(seq,)], "s string")
    assert df.select(sequences.compress_homopolymers(F.col("s"), m)).first()[0] == want
    assert sequences._compress(np.frombuffer(seq.encode(), np.uint8), m).tobytes().decode() == want


def test_seqsim(spark):
    a, b, c = (sequences.kmer_counts(s.encode(), 4) for s in ("ACGTACGTACGTACGT", "ACGTACGTACGTACGA", "TTTTGGGGCCCCAAAA"))
    cases = [(a, a, 2, 1), (a, b, 2, 0.96), (a, b, 1, 12 / 13), (a, c, 1, 0), (a, c, 2, 0), (a, -a, 1, 0)]
    for x, y, mink, want in cases:
        df = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<float>, b array<float>")
        assert df.select(metrics.seqsim(F.col("a"), F.col("b"), mink)).first()[0] == pytest.approx(want, abs=1e-6)
        assert 1 - vectors.distances_of(x, y, mink) == pytest.approx(want, abs=1e-6)
        assert cluster.distances(np.stack([x, y]), mink)[0, 1] == pytest.approx(1 - want, abs=1e-6)


def test_sizesim_and_overlap(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 50, 0.02), (90, 100, 0.9), (7, 7, 1.0), (-90, 100, 0.9)], "a int, b int, w double")
    for row in df.select(metrics.sizesim(F.col("a"), F.col("b")).alias("g"), "w", "a", "b").collect():
        assert row.g == pytest.approx(row.w)
        assert vectors.size_ratios(row.a, row.b) == pytest.approx(row.w)
    df = spark.createDataFrame([(0, 5, 5, 9, False), (0, 6, 5, 9, True), (0, 0, 0, 9, False)], "a int, b int, c int, d int, w boolean")
    assert all(r.g == r.w for r in df.select(metrics.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g"), "w").collect())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=4, max_size=4), st.lists(st.integers(-5, 5), min_size=4, max_size=4), st.integers(1, 3))
def test_similarity_properties(a, b, mink):
    a, b = np.array(a, np.float32), np.array(b, np.float32)
    s = 1 - vectors.distances_of(a, b, mink)
    assert s == 1 - vectors.distances_of(b, a, mink)
    assert 0 <= s <= 1 and not math.isnan(s)


def test_iupac(spark):
    df = spark.createDataFrame([("ACGTRYSWKMBDHVNryswkmbdhvn",)], "s string")
    assert df.select(sequences.plain_bases(F.col("s"))).first()[0] == "ACGTACCAGACAAANaccagacaaan"
