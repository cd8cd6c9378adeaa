"""Language identification by Bayesian evidence fusion.

The posterior of a language is proportional to

    prior(language | host) x likelihood(text) x likelihood(declared language) x likelihood(suffix)

* Text: naive Bayes over hashed byte trigrams of the letters, tempered (``TEMPER``), as neighbouring
  trigrams aren't independent.  Counts come from all labelled training texts.  The table has 2^16 cells a
  language, or, where ``lang`` has very many values, as many fewer as keep it in ``MODEL_BYTES``.
* Declared markup language: right with probability ``DECLARED``, else any language alike.
* Address suffix: posteriors of the texts of all pages with that suffix, add-one smoothed, relative to
  the prior of all and to the power ``SUFFIX_WEIGHT``.
* Host prior: grouped sums of text posteriors by host, smoothed towards those of its domain, which
  are smoothed towards those of all (``SMOOTHING`` pseudo-counts a level), a page's own text left in:
  one page among many hardly moves its host.

Besides the known languages there is ``und`` (undetermined): every trigram is alike to it, so
texts that are no language at all, or empty, end there and are rejected.

Sums by host combine in the tasks before they are shuffled, and the join back to pages is salted.

Defined cases: null or empty text, declared language, host or suffix is no evidence; unknown declared
languages too; a row with neither a trigram nor a known declared language is ``und``; of equally probable languages the first by name wins; repeated rows get one row each;
without training texts all is ``und``; an empty table gives no rows; other columns are ignored, or kept
(``keep_known_languages``), whatever their names.  A text is in the memory of one task, about twenty
times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.functions.joins import checked_broadcast, salted_join
from driftmap.llm import words
from driftmap.llm.tables import summed_table
from driftmap.llm.text import ascii_lower
from driftmap.sources.scratch import made, materialize, numbered, without

TRIGRAM_BITS = 16
TEMPER = 0.1
DECLARED = 0.9
SMOOTHING = 20.0
#: Prior probability of no language at all.
UNKNOWN = 0.01
#: Bytes of the model's table; beyond some 250 languages trigrams share cells, so that it stays within.
MODEL_BYTES = 64 << 20
#: Weight of the suffix, whose pages' texts count already by host.
SUFFIX_WEIGHT = 0.5
NONE = "und"
#: Bytes of text whose trigrams are made at a time.
CHUNK = 1 << 18
#: Bytes of texts whose likelihoods are summed at a time; a longer text is whole.
LOG_BYTES = 500_000

_FOLD = np.arange(256, dtype=np.int32)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32


def cell_bits(languages: int) -> int:
    """Bits of a cell's number: TRIGRAM_BITS, or as many as ``languages`` leave room for, 8 at least."""
    return max(8, min(TRIGRAM_BITS, (MODEL_BYTES // (4 * (languages + 1))).bit_length() - 1))


def trigrams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, doc) of every byte trigram with a letter in its middle; all but letters count as blank."""
    data, offsets = words.raw(texts)
    if len(data) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    use, cells = np.zeros(len(data) - 2, bool), []
    for at in range(0, len(use), CHUNK):  # 64-bit temporaries of a chunk only
        folded, own = _FOLD[data[at : at + CHUNK + 2]], doc[at : at + CHUNK + 2]
        some = (folded[1:-1] != 32) & (own[2:] == own[:-2])
        use[at : at + CHUNK] = some
        mixed = words.mix((folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:])[some].astype(np.uint64))
        cells.append((mixed & np.uint64((1 << bits) - 1)).astype(np.int32))
    return np.concatenate(cells), doc[1:-1][use]


def train_text_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their (cells, languages + 1) log probabilities from ``labelled`` (text, lang); the last
    column is ``und``, all trigrams alike."""
    found = [r.lang for r in labelled.where("lang IS NOT NULL").select("lang").distinct().orderBy("lang").collect()]  # the languages
    place, bits = {x: k for k, x in enumerate(found)}, cell_bits(len(found))
    size = 1 << bits

    def count(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        at = 0
        for texts in words.slices(batch.column("text")):
            own = batch.column("lang").slice(at, len(texts))
            at += len(texts)
            which = np.array([place.get(x, -1) for x in own.to_pylist()], np.int32)  # size times languages is far below 2^31
            cell, doc = trigrams(texts, bits)
            known = which[doc] >= 0
            yield np.bincount(which[doc[known]] * size + cell[known], minlength=len(found) * size)

    counts = summed_table(labelled.select("text", "lang"), max(1, len(found)) * size, count).reshape(-1, size)[: len(found)].T + 0.5
    log = np.log(counts / counts.sum(axis=0)) if found else np.zeros((size, 0))
    return found, np.hstack([log, np.full((size, 1), -np.log(size))]).astype(np.float32)


def text_logs(texts: pa.Array, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, languages + 1) tempered log likelihoods, and each row's number of trigrams."""
    cell, doc = trigrams(texts, len(log).bit_length() - 1)
    n = np.bincount(doc, minlength=len(texts))
    out = np.stack([np.bincount(doc, log[cell, k], len(texts)) for k in range(log.shape[1])], axis=1)
    return out * TEMPER, n


def with_text_logs(pages: DataFrame, log, languages: list[str]) -> DataFrame:
    """``pages`` (any columns, text last) with ``logs`` and the posterior ``p`` of the text in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in words.slices(batch.column("text"), LOG_BYTES):
                logs, n = text_logs(texts, log.value)
                own = np.exp(logs - logs.max(axis=1, keepdims=True))
                own /= own.sum(axis=1, keepdims=True)
                array = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                rest = [batch.column(k).slice(at, len(texts)) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n.astype(np.int64)), array(logs), array(own)], names=[*batch.schema.names[:-1], "n_trigrams", "logs", "p"])
                at += len(texts)
        words.give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema[:-1])
    return pages.mapInArrow(run, f"{schema}, n_trigrams long, logs array<double>, p array<double>")


def summed(size: int) -> Column:
    """The aggregate that adds up ``p`` element by element."""
    return F.array(*[F.coalesce(F.sum(F.get("p", F.lit(k))), F.lit(0.0)) for k in range(size)])


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def bound(value: Column, f) -> Column:
    """f of ``value``, which is computed once, also where f uses it for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def host_priors(pages: DataFrame, languages: list[str]) -> tuple[DataFrame, list[float]]:
    """(host, prior array), host sums smoothed by their domain's, those by the sums of all; and the
    prior of all."""
    size = len(languages) + 1
    by_host = materialize(pages.where("host IS NOT NULL").groupBy("host", "domain").agg(summed(size).alias("p")), "hosts")
    every = by_host.agg(summed(size).alias("p")).first().p
    known = sum(every[:-1])
    root = [(x + 1) / (known + size - 1) * (1 - UNKNOWN) for x in every[:-1]] + [UNKNOWN]
    smoothed = lambda p, above: bound(total(p) + SMOOTHING, lambda n: F.zip_with(p, above, lambda x, y: (x + SMOOTHING * y) / n))
    every_host = F.array(*map(F.lit, root))
    domains = by_host.groupBy("domain").agg(summed(size).alias("_p")).select("domain", smoothed(F.col("_p"), every_host).alias("above"))
    joined = salted_join(by_host, domains.where("domain IS NOT NULL"), ["domain"], ["host"], "left")
    return joined.select("host", smoothed(F.col("p"), F.coalesce("above", every_host)).alias("prior")), root


def identify(pages: DataFrame, languages: list[str], log_table: np.ndarray) -> DataFrame:
    """``pages`` (key columns, then host, domain, suffix, declared, text) with lang, posterior, kept."""
    log = pages.sparkSession.sparkContext.broadcast(log_table)
    size = len(languages) + 1
    keys = pages.columns[:-5]
    seen = materialize(with_text_logs(pages, log, languages), "seen")
    priors, root = host_priors(seen.where("n_trigrams > 0"), languages)
    every = F.array(*map(F.lit, root))
    suffixes = seen.where("suffix IS NOT NULL AND n_trigrams > 0").groupBy(F.col("suffix").alias("_suffix")).agg(summed(size).alias("_p"))
    # How much likelier the suffix makes each language, to its weight.
    likelier = bound(total(F.col("_p")) + size, lambda n: F.zip_with("_p", every, lambda x, r: F.log((x + 1) / n / r) * SUFFIX_WEIGHT))
    suffix_rows = checked_broadcast(materialize(suffixes.select("_suffix", likelier.alias("by_suffix")), "suffixes"))
    priors = materialize(priors, "priors")  # a row for each host
    few = checked_broadcast(priors)
    joined = seen.join(few, "host", "left") if few is not priors else salted_join(seen, priors, ["host"], keys, "left")
    joined = joined.join(suffix_rows, F.col("suffix") == F.col("_suffix"), "left")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, languages)) if languages else F.expr("array()"), F.col("declared")), F.lit(0))
    joined = joined.withColumn("declared_at", place)
    right, wrong = float(np.log(DECLARED)), float(np.log((1 - DECLARED) / max(1, size - 1)))
    logs = added(F.col("logs"), F.transform(F.coalesce("prior", every), lambda p: F.log(p)))
    logs = F.when(F.col("by_suffix").isNull(), logs).otherwise(added(logs, F.col("by_suffix")))
    fused = joined.withColumn("fused", logs)
    said = F.transform("fused", lambda x, k: x + F.when(k + 1 == F.col("declared_at"), right).otherwise(wrong))
    fused = fused.withColumn("fused", F.when(F.col("declared_at") == 0, F.col("fused")).otherwise(said)).withColumn("most", F.array_max("fused"))
    posterior = 1 / bound(F.col("most"), lambda m: F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - m)))
    lang = F.element_at(F.array(*map(F.lit, [*languages, NONE])), F.array_position("fused", F.col("most")).cast("int"))
    named = F.when((F.col("n_trigrams") == 0) & (F.col("declared_at") == 0), NONE).otherwise(lang)
    found = fused.select(*keys, named.alias("lang"), posterior.alias("posterior"))
    return found.select(*keys, "lang", "posterior", (F.col("lang") != NONE).alias("kept"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, host, domain, suffix, declared, text of raw web pages."""
    host = ascii_lower(F.regexp_extract("url", r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    html = F.coalesce("html", F.lit(""))
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    declared = ascii_lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    some = lambda c: F.when(c != "", c)
    named = pages.select("page_id", some(host).alias("host"), some(declared).alias("declared"), body.alias("text"))
    return named.select("page_id", "host", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"), "declared", "text")


def document_evidence(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, then evidence: a document has its text, and its source in the place of a host."""
    none = F.lit(None).cast("string")
    return docs.select(key, F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("declared"), "text")


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is in none of the languages that ``lang`` names.  Each row is
    judged by itself, also where rows share a doc_id or have none; all columns stay as they are."""
    rows, row = numbered(docs, "language-rows")
    since = made()
    languages, log = train_text_model(rows)
    found = identify(document_evidence(rows, row), languages, log)
    return without(rows, row, found.where("NOT kept").select(row), since)
