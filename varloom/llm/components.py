"""Distributed connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): each node of an edge with the smallest node it is linked to.

    Every round points nodes at the smallest node they know, which halves path lengths; minima are
    combined before the shuffle and each round is written, so both join sides are exchanged tables that
    adaptive execution can split at a hub. Null ends and self links add nothing to the classes.
    """
    scratch = Scratch()
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = scratch.written(e, "edges")
    nodes = scratch.written(e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct(), "nodes")
    last = None
    while True:
        for large in (True, False):
            e = _star(e, large, scratch)
            scratch.drop(keep=(e, nodes))
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    out = nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left")
    out = written(out.select("node", F.coalesce("component", "node").alias("component")), "components")
    scratch.drop()
    return out


def _star(e: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One round. large: both directions, every larger neighbour is linked to the smallest of the closed
    neighbourhood; small: each node's smaller neighbours, itself included, are linked to their minimum."""
    if large:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    best = scratch.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
    linked = both.join(best, "u")
    if large:
        new = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(best.select("u", F.col("m").alias("v")))
    return scratch.written(new.where("u <> v").distinct(), "star")
