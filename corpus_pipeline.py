"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

All but the last return the columns of documents. Documents go where the quality rules reject them, where
a near copy with a smaller id stays, and where they hold a benchmark item; text goes line by line in the
first stage and byte by byte where it repeats another document. No SQL expresses the samples, suffix arrays
and pieces of the later stages, so `ORACLE_SQL` is None and tests compare the stages with brute force.

Defined cases: null and empty texts fail the quality rules, so that later stages see them only if given them directly:
then near-dedup, suffix dedup and decontamination keep them, and they have no ids; rows are told by id and text, and of
repeated rows near-dedup keeps one; null ids are kept as such; empty tables give empty results; further columns pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import decontaminate, minhash, quality, sentencepiece_viterbi, suffix_dedup
from varloom.llm.common import Scratch, read_table
from varloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    return quality.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate class."""
    return minhash.keep_first(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that repeat an earlier document."""
    own = {c: f"__own_{c}" for c in docs.columns if c in suffix_dedup.ADDED}
    cut = suffix_dedup.remove_repeats(docs.withColumnsRenamed(own)).drop(*suffix_dedup.ADDED).withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it; beside doc_id and, where documents have them, lang and source."""
    names = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    out = sentencepiece_viterbi.encode(docs.select(*names, "text"), tokenizer_path("piece_bpe_32k.model"), check="round_trip")
    return out.select(*names, F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = read_table(spark, sf_dir, "documents"), Scratch()
    for name, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        tables.drop(keep=(docs,))  # the stage before has been read
    return STAGES[-1][1](spark, docs, sf_dir)
