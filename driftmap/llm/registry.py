"""The corpus operators' queries over the test tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.functions.joins import checked_broadcast
from driftmap.llm import divergence, exact_dedup, language, licences, lm_scoring, media, mixing, ngram_join, oracles, packing, prefix_trie, quality, token_files, url_filter

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def rank_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled good; background: all others."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("_good")).distinct()
    docs = table(spark, sf_dir, "documents").join(checked_broadcast(good), F.col("doc_id") == F.col("_good"), "left")
    return lm_scoring.cross_entropy_difference(docs.select("doc_id", "text", F.col("_good").isNotNull().alias("target")))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every document; the text model learns from documents outside the held-out fold."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    held_out = quality.held_out(F.col("doc_id"))
    known, log = language.train_text_model(docs.where(~held_out))
    on_pages = language.identify(language.page_evidence(pages), known, log)
    on_docs = language.identify(language.document_evidence(docs), known, log).withColumn("held_out", held_out)
    return on_docs.unionByName(on_pages, allowMissingColumns=True)


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("found")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": near,
    "op2_exact_dedup": exact,
    "op3_quality_ranking": rank_quality,
    "op4_lm_difference": lm_difference,
    "op5_source_mixing": mix,
    "op6_language_id": languages,
    "op7_url_filter": urls,
    "op8_packing": pack,
    "op9_media_png": images,
    "op10_token_files": tokens,
    "op11_source_divergence": audit,
    "op12_license_scan": scan,
    "op13_prefix_trie": tree,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op2_exact_dedup": oracles.EXACT_DEDUP,
    "op5_source_mixing": oracles.source_mixing(),
    "op7_url_filter": oracles.url_filter(RULES),
    "op11_source_divergence": oracles.source_divergence(),
    "op12_license_scan": oracles.licence_scan(),
    "op13_prefix_trie": oracles.prefix_tree(),
}
