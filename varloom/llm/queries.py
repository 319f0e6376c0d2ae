"""The opN_ queries: thin digests over the operators, with production parameters, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, minhash, quality, sentencepiece_viterbi, sharding, suffix_dedup, token_files, url_filter
from .common import new_path, read_table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SHARD_BYTES = 8 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def url_alias_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's operator where links are: no page of the tables has one, so canonical tags, refresh redirects and a redirect
    log are made from page ids. A tenth of the pages point to one blocked hub; others to mirrors, five in a chain."""
    i = F.col("page_id")
    mirror = lambda n: F.concat(F.lit("http://mirror.org/"), n.cast("string"))
    here, tag = mirror(F.floor(i / 40)), i % 10
    link = lambda to: F.concat(F.lit('<link rel="canonical" href="'), to, F.lit('">'))
    move = lambda to: F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), to, F.lit('">'))
    html = (
        F.when(tag == 0, link(F.lit("http://hub.net/es/front"))).when(tag == 1, link(here)).when(tag == 2, move(here))
        .when(tag == 3, F.concat(link(here), move(F.concat(F.lit("http://b.net/fr/"), F.floor(i / 400).cast("string")))))
        .when((tag == 4) & (F.floor(i / 40) % 5 != 4), link(mirror(F.floor(i / 40) + 1)))
    )
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))
    log = pages.where("page_id % 30 = 5").select(F.col("url").alias("src"), here.alias("dst"))
    log = log.union(pages.where("page_id % 280 = 5").select(here.alias("src"), F.lit("http://ok.com/x").alias("dst")))
    return url_filter.judge_urls(pages, URL_RULES, log)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(read_table(spark, sf_dir, "conversations"))
    span = lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))
    return out.select("conv_id", "perspective", "n_turns", "text", F.array_join(F.transform("mask", span), ",").alias("mask"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars"]
    return quality.judge(docs).select("doc_id", *[F.col("quality")[n].alias(n) for n in names])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(read_table(spark, sf_dir, "documents"))
    return langid.identify(read_table(spark, sf_dir, "pages"), model)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.assign_shards(docs, limit=SHARD_BYTES)
    return out.select("doc_id", "shard.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.col("leaks.item_id")))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_min(F.col("leaks.edits")).alias("least_edits"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, keep_text=False)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    docs = read_table(spark, sf_dir, "documents")
    manifest = token_files.write_tokens(docs, path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, path, manifest)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.digest(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


ALL = (
    op1_url_filters,
    op2_chat_formatting,
    op3_quality_rules,
    op4_language_id,
    op5_sharding,
    op6_decontamination,
    op7_suffix_dedup,
    op8_minhash,
    op9_token_files,
    op10_sentencepiece,
)


def queries() -> dict:
    return {f.__name__: f for f in (*ALL, url_alias_classes)}
