"""Extendible hashing, in DataFrame functions only.

A directory is indexed by the leading bits of a 60-bit hash of the key; a bucket over the byte limit
splits on its next bit, and only such buckets do. Bucket sizes come from one aggregation of the rows into
fine cells, rolled up over all depths, so the rows are not read again for every split. Cells that are
still too large at the finest depth are counted again with more bits.

Rows whose whole hash is equal cannot be told apart by bits: if they alone exceed the limit, they are
dealt to overflow pages (0, 1, ...) by their running number, as overflow chains do. One row larger than
the limit has a page to itself, the only shard over the limit.

Defined cases: null texts count 0 bytes; null keys share one hash; repeated rows are each placed; an
empty table gives an empty result; extra columns pass through `assign_shards` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

HASH_BITS = 60
_STEP = 5
_ROLL = 8


def key_hash(key: Column) -> Column:
    """60 bits of the md5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _cell(bits: int) -> Column:
    return F.shiftright("h", HASH_BITS - bits)


def directory(sized: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(prefix, depth, cell, shard_bytes) per used cell of the finest depth reached, and that depth."""
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + _STEP)
    cells = written(sized.groupBy(_cell(bits).alias("cell")).agg(F.sum("bytes").alias("b"), F.count_distinct("h").alias("keys")), "cells")
    while bits < HASH_BITS and not cells.where((F.col("b") > limit) & (F.col("keys") > 1)).isEmpty():
        bits = min(HASH_BITS, bits + 2 * _STEP)
        cells = written(sized.groupBy(_cell(bits).alias("cell")).agg(F.sum("bytes").alias("b"), F.count_distinct("h").alias("keys")), "cells")
    fits, shallow = _fitting(cells, bits, limit)
    # a prefix above the shallowest fitting one is too large, whatever it is: the directory needs no row for it
    level = cells.select("cell", F.explode(F.sequence(F.lit(shallow), F.lit(bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    hit = level.join(fits.hint("merge"), ["depth", "prefix"])
    best = hit.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s"))
    return written(best.select("cell", "s.depth", "s.prefix", "s.shard_bytes"), "directory"), bits


def _fitting(cells: DataFrame, bits: int, limit: int) -> tuple[DataFrame, int]:
    """((depth, prefix, shard_bytes) of the prefixes that need no split, the least depth of them or a smaller one).

    Cells are rolled up _ROLL depths at a time, from the finest: once no prefix of a depth fits, none above it does,
    so the few prefixes near the root, which hold all rows, are never keys of anything."""
    base, high, every = cells.select(F.col("cell").alias("prefix"), "b", "keys"), bits, None
    while True:
        low = max(0, high - _ROLL)
        level = base.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), F.col("prefix").alias("__p"), "b", "keys")
        level = level.withColumn("prefix", F.expr(f"shiftright(__p, {high} - depth)"))
        sums = written(level.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("keys").alias("keys")), "level")
        ok = (F.col("b") <= limit) | (F.col("keys") == 1) | (F.col("depth") == bits)
        fits = sums.where(ok).select("depth", "prefix", F.col("b").alias("shard_bytes"))
        every = fits if every is None else every.unionByName(fits.where(F.col("depth") < high))
        if low == 0 or sums.where(ok & (F.col("depth") == low)).isEmpty():
            return every, low
        base, high = sums.where(F.col("depth") == low).select("prefix", "b", "keys"), low


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 8 << 20) -> DataFrame:
    """docs with struct column `shard`: prefix, depth, page, shard_bytes, bytes."""
    spare = "__extendible"
    bytes_ = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = docs.withColumn(spare, F.struct(key_hash(F.col(key)).alias("h"), bytes_.alias("bytes")))
    sized = written(rows.select(f"{spare}.h", f"{spare}.bytes"), "sized")
    cells, bits = directory(sized, limit)
    placed = rows.withColumn("__cell", F.shiftright(F.col(spare)["h"], HASH_BITS - bits))
    cells = cells.select(F.col("cell").alias("__cell"), F.struct("prefix", "depth", "shard_bytes").alias("__dir"))
    # the directory grows with the input, so it is shuffled and never broadcast; cells are even, being hash bits
    placed = placed.join(cells.hint("merge"), "__cell")
    page = F.lit(0).cast("long")
    if not cells.where(F.col("__dir.shard_bytes") > limit).isEmpty():
        placed, page = _pages(placed, spare, limit)
    out = F.struct(
        F.col("__dir.prefix").alias("prefix"), F.col("__dir.depth").alias("depth"), page.alias("page"),
        F.col("__dir.shard_bytes").alias("shard_bytes"), F.col(spare)["bytes"].alias("bytes"),
    )
    return placed.select(*[c for c in docs.columns if c != "shard"], out.alias("shard"))


def _pages(placed: DataFrame, spare: str, limit: int) -> tuple[DataFrame, Column]:
    """Running byte sums of rows of equal hash: within a task's rows by a window, across tasks by prefix sums.

    A page takes limit/2 of running bytes, so a row of up to limit/2 never makes it overflow; a larger row
    starts a page of its own. The rows are written first, so that their task numbers stay.
    """
    placed = written(placed.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "paged")
    over = F.col("__dir.shard_bytes") > limit
    big = F.col(spare)["bytes"] > limit // 2
    chunk = F.shiftright("__i", 12)  # bounded windows: 4,096 rows of a task
    w = Window.partitionBy("__dir", "__p", "__chunk")
    small = F.when(big, 0).otherwise(F.col(spare)["bytes"])
    placed = placed.withColumn("__chunk", F.when(over, chunk).otherwise(F.col("__i")))
    sums = placed.where(over).groupBy("__dir", "__p", "__chunk").agg(F.sum(small).alias("s"), F.sum(big.cast("long")).alias("n"))
    run = Window.partitionBy("__dir").orderBy("__p", "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__dir", "__p", "__chunk", F.coalesce(F.sum("s").over(run), F.lit(0)).alias("__s"), F.coalesce(F.sum("n").over(run), F.lit(0)).alias("__n"))
    placed = placed.join(base, ["__dir", "__p", "__chunk"], "left")
    before = w.orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    s = F.col("__s") + F.coalesce(F.sum(small).over(before), F.lit(0))
    n = F.col("__n") + F.coalesce(F.sum(big.cast("long")).over(before), F.lit(0))
    half = F.lit(max(1, limit // 2))
    page = F.when(~over, 0).when(big, -1 - n).otherwise(F.floor(s / half)).cast("long")
    placed = placed.withColumn("__page", page)
    # a page is a shard of its own size
    sizes = placed.where(over).groupBy("__dir", "__page").agg(F.sum(F.col(spare)["bytes"]).alias("__bytes"))
    placed = placed.join(sizes, ["__dir", "__page"], "left")
    return placed.withColumn("__dir", F.col("__dir").withField("shard_bytes", F.coalesce("__bytes", F.col("__dir.shard_bytes")))), F.col("__page")
