"""A corpus pipeline of five stages, each a Spark job over what the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``docs``.

Rows are judged each by itself, also where they share a doc_id or have none; columns with any names stay
as they are, and an empty table gives no rows.

1. language_id: documents whose text is in no known language go.
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. ngram_jaccard: of texts linked by a similarity of 0.8 over 5-word shingles the smallest doc_id stays.
4. source_mixing: rows repeat, or go, as the mix of the sources to their target weights takes them.
5. packing: what is left, tokenised, in windows of 2,048 tokens; a row for each piece of a document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftmap.llm import exact_dedup, language, mixing, ngram_join, packing
from driftmap.sources.scratch import made, materialize, release

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known_languages(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_to_mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]
#: Packing and language identification can't be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = made()
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(before, -1)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
