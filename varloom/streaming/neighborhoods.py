"""Neighbourhoods of a stream by event time: session windows close once the watermark passes their gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_neighborhoods(stream: DataFrame, key: str, ts: str, gap: str, lateness: str) -> DataFrame:
    """(key, start, end, n) of sessions; works on streams and on tables (where the watermark does nothing)."""
    marked = stream.withWatermark(ts, lateness)
    return marked.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
