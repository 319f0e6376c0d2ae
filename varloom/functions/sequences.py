"""k-mer features and sequence functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Nucleotide codes; any other letter counts as A.
CODES = {"A": 0, "G": 1, "C": 2, "T": 3}
_LOOKUP = np.zeros(256, np.uint8)
for _base, _code in CODES.items():
    _LOOKUP[ord(_base)] = _LOOKUP[ord(_base.lower())] = _code
# The first plain base that each ambiguity letter stands for.
AMBIGUOUS, PLAIN = "RYSWKMBDHVryswkmbdhv", "ACCAGACAAAaccagacaaa"


def encode_bases(seq: Column) -> Column:
    """Digits 0 to 3 of a sequence."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^AGCT]", "A"), "AGCT", "0123")


def plain_bases(ref: Column) -> Column:
    """Ambiguity letters of a REF replaced, case kept."""
    return F.translate(ref, AMBIGUOUS, PLAIN)


def compress_homopolymers(seq: Column, longest: int) -> Column:
    """Runs of `longest` or more equal characters cut to max(1, longest - 1); 0 leaves all."""
    if longest <= 0:
        return seq
    kept = max(1, longest - 1)
    return F.regexp_replace(seq, f"(.)\\1{{{max(longest - 1, 1)},}}", "$1" * kept)


def _compress(codes: np.ndarray, longest: int) -> np.ndarray:
    if longest <= 0 or not len(codes):
        return codes
    start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    size = np.diff(np.append(start, len(codes)))
    kept = np.where(size >= max(longest, 2), max(1, longest - 1), size)
    return np.repeat(codes[start], kept)


def kmer_counts(seq: bytes, k: int, negative: bool = False, longest: int = 0) -> np.ndarray:
    """float32[4**k]: overlapping k-mers of a sequence by base-4 index, first base most significant."""
    out = np.zeros(4**k, np.float32)
    raw = _compress(np.frombuffer(seq, np.uint8), longest)
    n = len(raw) - k + 1
    if n > 0:
        codes = _LOOKUP[raw].astype(np.int64)
        index = np.zeros(n, np.int64)
        for j in range(k):
            index = index * 4 + codes[j : j + n]
        out += np.bincount(index, minlength=4**k).astype(np.float32)
    return -out if negative else out


def kmer_udf(k: int, longest: int = 0):
    """Column function sequence -> array<float> of k-mer counts (one numpy pass a batch row)."""

    @pandas_udf("array<float>")
    def count(seqs: pd.Series) -> pd.Series:
        return seqs.map(lambda s: None if s is None else kmer_counts(s.encode(), k, longest=longest))

    return count


def kmer_counts_sql(seq: Column, k: int) -> Column:
    """map<int, long> of k-mer index to count in SQL functions; for short or materialised strings, since the
    explode-free form still touches every position."""
    digits = encode_bases(seq)

    def tally(keys: Column) -> Column:
        distinct = F.array_sort(F.array_distinct(keys))
        sizes = F.transform(distinct, lambda d: F.size(F.filter(keys, lambda x: x == d)).cast("long"))
        return F.map_from_arrays(distinct, sizes)

    index = F.transform(F.sequence(F.lit(1), F.length(digits) - k + 1), lambda i: F.conv(F.substring(digits, i, F.lit(k)), 4, 10).cast("int"))
    index = F.when(F.length(digits) >= k, index).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(index), tally)[0]
