"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own content says so (``CUT``), so texts that share passages share chunks.
Chunks move through one shuffle, where copies combine before they are sent; a chunk's identifier is
its SHA-256, *verified* there: if two different chunks ever shared a digest, both would get an ordinal
appended.  From then on a document is
its recipe, the ordered list of identifiers, 32 bytes for about a thousand of text; equal recipes
mean equal texts, and only recipes are grouped and joined.

All of it is DataFrame functions.  Groups are counted with map-side partial aggregation and joined
back with salted keys, so a text that a third of all rows share is no burden to one task.

Defined cases: a null text counts as empty; the empty text is a text like any other (empty recipe);
of rows that repeat both text and doc_id exactly one stays; a null doc_id is smaller than any other
and stays only if its whole group is null; an empty table gives no rows; other columns are ignored, or
kept (``drop_exact_copies``), whatever their names.  A chunk moves as one value, so a text of any
length is a row of digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.functions.joins import salted_join
from driftmap.llm.text import ascii_lower
from driftmap.sources.scratch import made, materialize, numbered, without

#: Chunks have 256 to 4,096 characters and end behind a blank that follows two letters of these
#: classes; a text without such places is cut at the longest length.
CUT = r"(?s)(?:.{256,4096}?(?<=[aeiourn][dghlmnst][ \n\t])|.{1,4096})"


def sha256(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk.cast("binary"), 256))


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def ambiguous_ids(texts: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests that two different chunks share.  This is the one place where chunk texts move: each
    task sends one least and one greatest chunk for a digest, and they must be the same bytes."""
    chunks = texts.select(F.explode(chunks_of(F.col("norm"))).alias("chunk")).select(digest(F.col("chunk")).alias("id"), "chunk")
    return chunks.groupBy("id").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("least <> most").select("id")


def numbered_chunks(texts: DataFrame, ids: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(chunk, verified) of all chunks with one of the digests ``ids``: the digest with an ordinal."""
    chunks = texts.select(F.explode(chunks_of(F.col("norm"))).alias("chunk")).select(digest(F.col("chunk")).alias("id"), "chunk")
    again = chunks.join(ids, "id", "left_semi").distinct()
    ordinal = F.row_number().over(Window.partitionBy("id").orderBy("chunk"))
    return again.select("chunk", F.concat("id", F.encode(ordinal.cast("string"), "UTF-8")).alias("verified"))


def recipes(docs: DataFrame, row: Column, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row a document: _row (what ``row`` gives), doc_id, recipe, text_sha256."""
    texts = docs.select(row.alias("_row"), "doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    spelled = lambda t: materialize(t.select("_row", "doc_id", F.transform(chunks_of(F.col("norm")), digest).alias("recipe"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "recipes")
    found = spelled(texts)
    clashes = materialize(ambiguous_ids(texts, digest), "clashes")
    if clashes.isEmpty():
        return found
    # Two chunks share a digest: rebuild the recipes of the documents that hold such chunks, from a
    # written table, so that rows keep their numbers.
    texts = materialize(texts, "texts")
    found = spelled(texts)
    chunks = texts.select("_row", F.posexplode(chunks_of(F.col("norm"))).alias("at", "chunk"))
    named = chunks.join(numbered_chunks(texts, clashes, digest), "chunk").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("at", "verified"))).alias("_new"))
    better = F.transform("recipe", lambda id, at: F.coalesce(F.try_element_at("_new", at), id))
    return found.join(named, "_row", "left").withColumn("recipe", F.when(F.col("_new").isNull(), F.col("recipe")).otherwise(better)).drop("_new")


def grouped_rows(docs: DataFrame, row: Column, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """_row, doc_id, keep_id, group_size, kept, text_sha256."""
    found = recipes(docs, row, digest)
    groups = found.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "_row")).alias("keep")).where("n > 1")
    joined = salted_join(found, groups, ["recipe"], ["_row"], "left")
    return joined.select(
        "_row",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("_row") == F.col("keep._row"))).alias("kept"),
        "text_sha256",
    )


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (after lower-casing A-Z) the row with the largest doc_id stays.
    """
    return grouped_rows(docs, F.monotonically_increasing_id(), digest).drop("_row")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    rows, row = numbered(docs, "exact-rows")
    since = made()
    gone = grouped_rows(rows, F.col(row)).where("NOT kept").select(F.col("_row").alias(row))
    return without(rows, row, gone, since)
