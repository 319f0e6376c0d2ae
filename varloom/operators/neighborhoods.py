"""Neighbourhoods: gaps and islands over sorted intervals, and their graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import overlaps


def neighborhoods(rows: DataFrame, gap: int, chrom: str = "chrom", start: str = "start", end: str = "end", order: str = "ordinal") -> DataFrame:
    """rows with `ne`, the smallest start of their neighbourhood.

    A row opens a neighbourhood if the largest end so far in its contig, plus gap, lies left of its start.
    """
    by = Window.partitionBy(chrom).orderBy(order)
    so_far = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(so_far + F.lit(gap) < F.col(start), 1).otherwise(0)
    marked = rows.withColumn("__opens", opens)
    marked = marked.withColumn("__island", F.sum("__opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("ne", F.min(start).over(Window.partitionBy(chrom, "__island"))).drop("__opens", "__island")


def binned_neighborhoods(rows: DataFrame, gap: int, width: int, chrom: str = "chrom", start: str = "start", end: str = "end", order: str = "ordinal") -> DataFrame:
    """The same with rows taken in start order, then by `order`, without one task a contig.

    Rows are walked in bins of `width`; the largest end and the neighbourhoods opened before each bin are
    carried in from one row a bin. Neighbourhoods themselves are then grouped by (contig, number).
    """
    at = rows.withColumn("__bin", F.floor(F.col(start) / F.lit(width)).cast("long"))
    before = Window.partitionBy(chrom).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = at.groupBy(chrom, "__bin").agg(F.max(end).alias("__far"))
    per_bin = per_bin.select(chrom, "__bin", F.max("__far").over(before).alias("__carried"))
    inner = Window.partitionBy(chrom, "__bin").orderBy(start, order)
    so_far = F.greatest(F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.col("__carried"))
    marked = at.join(per_bin, [chrom, "__bin"]).withColumn("__opens", F.when(so_far + F.lit(gap) < F.col(start), 1).otherwise(0))
    opened = marked.groupBy(chrom, "__bin").agg(F.sum("__opens").alias("__n"))
    opened = opened.select(chrom, "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__past"))
    numbered = marked.join(opened, [chrom, "__bin"]).withColumn("__island", F.col("__past") + F.sum("__opens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("ne", F.min(start).over(Window.partitionBy(chrom, "__island"))).select(*rows.columns, "ne")


def bounds(rows: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """(chrom, ne, start, end, n_variants) of each neighbourhood."""
    return rows.groupBy(chrom, "ne").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n_variants"))


def number_nodes(rows: DataFrame, chrom: str = "chrom", order: str = "ordinal") -> DataFrame:
    """rows with `node`: 1, 2, ... in file order within the neighbourhood; 0 and n + 1 are the anchors."""
    return rows.withColumn("node", F.row_number().over(Window.partitionBy(chrom, "ne").orderBy(order)))


def edges(nodes: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", with_anchors: bool = True) -> DataFrame:
    """(chrom, ne, src, dst): every pair i < j of nodes that do not overlap; anchors overlap nothing.

    The join is on the neighbourhood, never across it.
    """
    a = nodes.select(chrom, "ne", F.col("node").alias("src"), F.col(start).alias("s1"), F.col(end).alias("e1"))
    b = nodes.select(chrom, "ne", F.col("node").alias("dst"), F.col(start).alias("s2"), F.col(end).alias("e2"))
    pairs = a.join(b, [chrom, "ne"]).where((F.col("src") < F.col("dst")) & ~overlaps(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))
    out = pairs.select(chrom, "ne", "src", "dst")
    if not with_anchors:
        return out
    last = nodes.groupBy(chrom, "ne").agg((F.max("node") + 1).alias("last"))
    out = out.unionByName(nodes.select(chrom, "ne", F.lit(0).alias("src"), F.col("node").alias("dst")))
    out = out.unionByName(nodes.join(last, [chrom, "ne"]).select(chrom, "ne", F.col("node").alias("src"), F.col("last").alias("dst")))
    return out.unionByName(last.select(chrom, "ne", F.lit(0).alias("src"), F.col("last").alias("dst")))
