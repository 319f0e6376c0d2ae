"""Every query beside its SQL at the smallest scale, the entry point, and the stream."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from varloom.plans import source_queries, table_queries
from varloom.streaming.neighborhoods import session_neighborhoods

SF = "/root/testdata/sf0.001"


def plain(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) or x is pd.NA else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, row)) for row in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(table_queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = source_queries.QUERIES[name](spark, SF).toPandas(), duck.sql(table_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_vectors_are_products_of_floats(spark, tmp_path):
    """Floats next to a twentieth: a product of doubles stays below the whole number that SQL's floats reach."""
    twentieths = [k / 20 for k in range(-40, 41)]
    spark.createDataFrame([(i, twentieths[i : i + 64], 0) for i in range(18)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = table_queries.haplotype_sum(spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(con.sql(table_queries.SQL["haplotype_sum"]).df())


def test_parts_of_text_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(source_queries, "_PART", 100)
    path = source_queries._written(spark.range(1000).select("id", F.col("id").cast("string").alias("line")), "test", "id")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    assert lines.groupBy("file").count().agg(F.count("*"), F.max("count"), F.sum("count")).collect()[0][0] >= 8
    parts = [[int(r.value) for r in lines.where(F.col("file") == f.file).collect()] for f in lines.select("file").distinct().orderBy("file").collect()]
    assert sum(parts, []) == list(range(1000)) and max(map(len, parts)) < 250


def test_full_genotypes_are_what_was_planted(spark):
    nations = {r.s_suppkey: (r.s_nationkey, r.s_suppkey // 25) for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    got = {r.s_suppkey: r for r in table_queries.full_genotype(spark, SF).collect()}
    assert set(got) == set(nations)
    for k, r in got.items():
        alone = sum(v == nations[k] for v in nations.values()) == 1
        if k % 13 == 5 or nations[k][0] % 10 == 6:
            assert (r.gt, r.dp) == ("./.", 0)
        elif alone and nations[k][0] % 10 == 3:
            assert r.dp >= 8 and r.gt == ("1" if k % 4 < 2 else "0")
        elif alone:
            assert r.dp >= 8 and r.gt in {0: ("1|1",), 1: ("0|1", "1|0"), 2: ("0|0",), 3: ("0|0",)}[k % 4]


def test_kmers_of_whole_texts(spark):
    want, outside = {}, 0
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        raw = (r.text or "").encode()
        outside += any(not 32 <= b < 127 for b in raw)
        for i in range(len(raw) - 2):
            kmer = sum(max("AGCT".find(chr(b)), 0) * 4 ** (2 - j) for j, b in enumerate(raw[i : i + 3].upper()))
            want[r.item_id, kmer] = want.get((r.item_id, kmer), 0) + 1
    assert outside and {(r.item_id, r.kmer): r.n for r in table_queries.kmer_counts(spark, SF).collect()} == want


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_range_filters_reach_the_scan(spark):
    plan = table_queries.read_filters(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_" in plan and "l_extendedprice" not in plan


def test_stream_closes_the_sessions_of_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    out = session_neighborhoods(stream, "user_id", "ts", "2 hours", "1 hour")
    query = out.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    closed = {tuple(r) for r in spark.table("sessions").collect()}
    every = {tuple(r) for r in session_neighborhoods(events, "user_id", "ts", "2 hours", "1 hour").collect()}
    assert closed and closed <= every
    last = max(r[2] for r in closed)
    assert {r for r in every if r[2] < last} <= closed
