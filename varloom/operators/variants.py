"""Variant records: derived columns, filters (as flags, since rejected rows are still written), k-mer features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.sequences import kmer_counts
from ..params import GenotypeParams
from .intervals import first_live_region

TYPES = ("Ins", "Del", "Dup", "Inv", "Snp")


def variant_type(name: Column) -> Column:
    """Ins, Del, Dup, Inv or Snp; anything else is Unk. Case does not matter."""
    short = F.initcap(F.lower(F.coalesce(name, F.lit(""))))
    return F.when(short.isin(*TYPES), short).otherwise("Unk")


def record_size(ref: Column, alt: Column) -> Column:
    """Size for filtering: the length change; of equal lengths, 0 for single bases and the length otherwise."""
    r, a = F.length(ref), F.length(alt)
    return F.when(r == a, F.when(r == 1, 0).otherwise(r)).otherwise(F.abs(r - a)).cast("long")


def is_pass(filters: Column) -> Column:
    return (F.size(filters) == 0) | F.array_contains(filters, "PASS")


def valid_alt(alt: Column) -> Column:
    return ~alt.isin(".", "*") & ~alt.contains(":") & ~alt.contains("<")


def single_alt(alt: Column) -> Column:
    """The only ALT; none is '.', several are an error."""
    several = F.raise_error(F.concat(F.lit("multi-allelic record: "), alt))
    return F.when(alt.contains(","), several).otherwise(F.coalesce(F.when(alt != "", alt), F.lit(".")))


def derive(records: DataFrame) -> DataFrame:
    """records (chrom, pos, ref, alt, ...) with 0-based start and end, size (for filters) and delta (signed)."""
    alt = single_alt(F.col("alt"))
    out = records.withColumn("alt", alt)
    start = (F.col("pos") - 1).cast("long")
    delta = (F.length("alt") - F.length("ref")).cast("long")
    return out.withColumns({"start": start, "end": start + F.length("ref"), "size": record_size(F.col("ref"), F.col("alt")), "delta": delta})


def flag_keep(variants: DataFrame, regions: DataFrame, p: GenotypeParams) -> DataFrame:
    """variants with boolean `keep`; rows that fail a filter stay, to be written without a genotype."""
    inside = first_live_region(variants, regions)
    ok = valid_alt(F.col("alt")) & F.col("size").between(p.sizemin, p.sizemax) & F.col("in_region")
    if p.passonly:
        ok &= is_pass(F.col("filter"))
    return inside.withColumn("keep", F.coalesce(ok, F.lit(False))).drop("in_region")


def keep_tally(flagged: DataFrame, hoods: DataFrame) -> DataFrame:
    """One row: variants, kept and skipped ones, and neighbourhoods."""
    counts = flagged.agg(F.count("*").alias("n_variants"), F.count_if("keep").alias("n_kept"), F.count_if(~F.col("keep")).alias("n_skipped"))
    return counts.crossJoin(F.broadcast(hoods.agg(F.count("*").alias("n_neighborhoods"))))  # one row each


def feature_udf(k: int, longest: int):
    """(ref, alt) -> array<float>: k-mers of ALT less those of REF, both without the anchor base."""

    @pandas_udf("array<float>")
    def feature(ref: pd.Series, alt: pd.Series) -> pd.Series:
        out = [kmer_counts(a[1:].encode(), k, longest=longest) - kmer_counts(r[1:].encode(), k, longest=longest) for r, a in zip(ref, alt, strict=True)]
        return pd.Series(np.array(out, np.float32).tolist() if out else [], dtype=object)

    return feature
