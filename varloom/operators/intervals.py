"""Interval operators: regions, containment, binned range joins and point lookups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contig_regions(contigs: DataFrame) -> DataFrame:
    """(chrom, start, end, ordinal) of whole contigs; a contig without a length is an error."""
    length = F.when(F.col("length").isNull(), F.raise_error(F.concat(F.lit("no length for contig "), F.col("chrom")))).otherwise(F.col("length"))
    return contigs.select("chrom", F.lit(0).cast("long").alias("start"), length.cast("long").alias("end"), F.lit(0).cast("long").alias("ordinal"))


def bed_regions(contigs: DataFrame, bed: DataFrame) -> DataFrame:
    """BED rows on known contigs, in file order (sorted or not)."""
    return bed.join(contigs.select("chrom"), "chrom", "left_semi").select("chrom", "start", "end", "ordinal")


def split_genome(contigs: DataFrame, chunk: int) -> DataFrame:
    """(chrom, start, end) pieces of each contig of at most chunk bases."""
    pieces = contigs.where("length > 0").select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("start"))
    return pieces.select("chrom", "start", F.least(F.col("start") + chunk, F.col("length")).alias("end"))


def live_spans(regions: DataFrame) -> DataFrame:
    """(chrom, lo, hi, start, end): the starts lo..hi for which a region is the first, by ordinal, that does
    not end to the left of them. Such spans are disjoint: a region serves the starts beyond all earlier ends."""
    before = Window.partitionBy("chrom").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    seen = regions.withColumn("__seen", F.coalesce(F.max("end").over(before), F.lit(-1).cast("long")))
    return seen.where("end > __seen").select("chrom", (F.col("__seen") + 1).alias("lo"), F.col("end").alias("hi"), "start", "end")


def first_live_region(variants: DataFrame, regions: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", width: int = 1 << 20) -> DataFrame:
    """variants with boolean `in_region`: the first region that does not end left of the variant's start contains
    it whole. Later overlapping regions do not count."""
    spans = live_spans(regions).select(F.col("chrom").alias("__chrom"), "lo", "hi", F.struct("start", "end").alias("__r"))
    spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor(F.col("hi") / width).cast("long"))))
    left = variants.withColumn("__bin", F.floor(F.col(start) / F.lit(width)).cast("long"))
    at = (F.col(chrom) == F.col("__chrom")) & (F.col("__bin") == F.col("__b")) & F.col(start).between(F.col("lo"), F.col("hi"))
    joined = left.join(spans, at, "left")
    inside = F.coalesce((F.col("__r.start") <= F.col(start)) & (F.col(end) <= F.col("__r.end")), F.lit(False))
    return joined.withColumn("in_region", inside).select(*variants.columns, "in_region")


def range_join(points: DataFrame, spans: DataFrame, on: str, point: Column, span_start: str, span_end: str, condition: Column, width: int) -> DataFrame:
    """points x spans where `condition` holds, by an equi-join on (on, bin).

    Every span is copied to the bins of `width` it touches, every point stands in one, so a pair meets
    once at most and Spark never plans a nested loop. `point` must lie within [span_start, span_end] for all
    pairs that satisfy the condition.
    """
    left = points.withColumn("__bin", F.floor(point / F.lit(width)).cast("long"))
    right = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(span_start) / width).cast("long"), F.floor(F.col(span_end) / width).cast("long"))))
    return left.join(right.withColumnRenamed(on, "__on"), (F.col(on) == F.col("__on")) & (left["__bin"] == right["__bin"]) & condition).drop("__on", "__bin")


def size_join(a: DataFrame, b: DataFrame, on: str, size_a: str, size_b: str, least: float) -> DataFrame:
    """Pairs of a and b, equal in `on`, among them all whose smaller size is at least `least` (below 1) of the larger, 0 counting as 1.

    Sizes meet in bins of their logarithm a hair wider than such a ratio spans: a size's own and the two beside it. Pairs
    much less alike are not made; those in between are left to a filter."""
    width = -1.001 * math.log(least)
    place = lambda c: F.floor(F.ln(F.greatest(F.abs(F.col(c)), F.lit(1)).cast("double")) / width)
    left = a.withColumn("__bin", F.explode(F.array(*[place(size_a) + k for k in (-1, 0, 1)])))
    return left.join(b.withColumn("__bin", place(size_b)), [on, "__bin"]).drop("__bin")


def spanning_counts(windows: DataFrame, spans: DataFrame, on: str, point: str, length: int, span_start: str, span_end: str, width: int) -> DataFrame:
    """windows with `n`, the number of spans that strictly hold [point, point + length]: start < point and
    end > point + length.

    No pair is made. A span no longer than the window holds none; of the others, those that start left of the point
    less those that end by point + length are the ones that hold it. Starts and ends are counted by place before the
    shuffle, then summed along each bin with the total of the bins before it, so a bin has at most three rows a
    place, however many windows and spans meet there.
    """
    long = spans.where(F.col(span_end) - F.col(span_start) > length)
    place = lambda df, at, kind, n: df.groupBy(F.col(on).alias("__on"), at.alias("__at")).agg(n.cast("long").alias("__n")).withColumn("__kind", F.lit(kind))
    # in the order of kinds at one place: ends count, then windows look, then starts count
    rows = place(long, F.col(span_end) - length, 0, -F.count("*")).unionByName(place(windows, F.col(point), 1, F.lit(0).cast("long") * F.count("*"))).unionByName(place(long, F.col(span_start), 2, F.count("*")))
    rows = rows.withColumn("__bin", F.floor(F.col("__at") / F.lit(width)).cast("long"))
    before = Window.partitionBy("__on").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    past = rows.groupBy("__on", "__bin").agg(F.sum("__n").alias("__s")).select("__on", "__bin", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__past"))
    inner = Window.partitionBy("__on", "__bin").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("__run", F.sum("__n").over(inner)).where("__kind = 1").join(past, ["__on", "__bin"])
    counted = counted.select("__on", "__at", (F.col("__run") + F.col("__past")).alias("n"))
    return windows.join(counted, (F.col(on) == F.col("__on")) & (F.col(point) == F.col("__at"))).drop("__on", "__at")


def interval_lookup(points: DataFrame, intervals: DataFrame, key: Sequence[str], on: str, point: str, value: str, width: int) -> DataFrame:
    """points with `value` of the first interval [start, end) that holds the point (by start, then end), or null."""
    spans = intervals.select(on, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col(value).alias("__value")).where("__e > __s")
    keyed = points.select(*dict.fromkeys([*key, on]), F.col(point).alias("__at"))
    hits = range_join(keyed, spans, on, F.col("__at"), "__s", "__e", (F.col("__s") <= F.col("__at")) & (F.col("__at") < F.col("__e")), width)
    first = hits.groupBy(*key).agg(F.min_by("__value", F.struct("__s", "__e")).alias(value))
    return points.join(first, list(key), "left")


def own_chunk(start: Column, chunk: int) -> Column:
    """The one chunk that owns a read: that of its start."""
    return F.floor(start / F.lit(chunk)).cast("long")
