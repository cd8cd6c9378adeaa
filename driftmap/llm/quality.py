"""Quality scores by Bradley-Terry ranking.

A text's strength is linear in its features (``text_features``: shares of bytes and of word shapes).
The strengths are learned from preference pairs: a text labelled good beats one labelled bad, with
probability sigmoid(strength difference), so the loss is the logistic loss on feature differences
(``fit_ranking``, Newton steps).  The threshold is the quantile of the training strengths that
leaves as many below it as were labelled bad, and a score is sigmoid(strength - threshold).

The model is fitted on at most ``FIT_ROWS`` labelled texts, chosen by a hash of doc_id, and scores
are computed for every whole text where it is read.

Defined cases: a null or empty text has all features zero and gets a score like any other; labels
that are null or repeated for a doc_id (the greatest counts) are fine; without labels of both kinds
every score is 0.5; repeated rows get one row each; an empty table gives no rows; other columns are
ignored.  A text is in the memory of one task, about twenty times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.functions.joins import checked_broadcast
from driftmap.llm import words

#: Labelled texts that the model is fitted on, at most.
FIT_ROWS = 20_000
PAIRS = 30_000
RIDGE = 1e-3

_UPPER, _LOWER, _DIGIT, _BLANK = 1, 2, 3, 4
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWER, _DIGIT
_KIND[[32, 9, 10, 11, 12, 13]] = _BLANK
BINS = 129  # ASCII bytes, all others in one
FEATURES = BINS + 36 + 8


def text_features(texts: pa.Array) -> np.ndarray:
    """(rows, FEATURES) float32: square roots of the shares of bytes and of pairs of byte kinds, and
    figures on words and lines."""
    w = words.Words(texts)
    data, rows = w.data, w.rows
    out = np.zeros((rows, FEATURES), np.float32)
    sizes = np.diff(w.offsets)
    doc = np.repeat(np.arange(rows), sizes)
    total = np.maximum(sizes, 1)[:, None]
    out[:, :BINS] = np.sqrt(np.bincount(doc * BINS + np.minimum(data, 128), minlength=rows * BINS).reshape(rows, BINS) / total)
    kind = _KIND[data] + (data >= 128) * 5
    pair = kind[1:] * 6 + kind[:-1]
    pair = pair[doc[1:] == doc[:-1]] + 36 * doc[1:][doc[1:] == doc[:-1]]
    out[:, BINS : BINS + 36] = np.sqrt(np.bincount(pair, minlength=rows * 36).reshape(rows, 36) / total)
    count = np.maximum(w.counts, 1)
    length = w.ends - w.starts
    mean = np.bincount(w.doc, length, rows) / count
    first_kind, last_kind = kind[w.starts], kind[w.ends - 1]
    key = w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.code.astype(np.uint64)
    distinct = np.bincount(w.doc[np.unique(key, return_index=True)[1]], minlength=rows)
    lines = np.bincount(doc[data == 10], minlength=rows)
    share = lambda mask: np.bincount(w.doc[mask], minlength=rows) / count
    figures = [np.minimum(mean / 10, 3), np.log1p(w.counts) / 10, distinct / count, share(first_kind == _UPPER), share(last_kind == 0), share(length > 20), np.log1p(lines) / 10, lines / count]
    out[:, BINS + 36 :] = np.stack(figures, axis=1)
    return out


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, features: np.ndarray) -> np.ndarray:
        strength = ((features - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(strength, -30, 30)))


def fit_ranking(features: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = 12, seed: int = 5) -> Ranking:
    """Bradley-Terry weights from pairs of a good and a bad row, each row in about as many pairs."""
    width = features.shape[1]
    mean = features.mean(axis=0) if len(features) else np.zeros(width)
    scale = features.std(axis=0) + 0.01 if len(features) else np.ones(width)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return Ranking(mean, scale, np.zeros(width), 0.0)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(better) * len(worse))
    pick = lambda side: np.concatenate([rng.permutation(side) for _ in range(-(-n // len(side)))])[:n]
    x = ((features - mean) / scale).astype(np.float64)
    weights = np.zeros(width)
    for_pairs = x[pick(better)] - x[pick(worse)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(for_pairs @ weights, -30, 30)))
        slope = for_pairs.T @ (1 - p) / n - RIDGE * weights
        curve = (for_pairs * (p * (1 - p))[:, None]).T @ for_pairs / n + RIDGE * np.eye(width)
        weights = weights + np.linalg.solve(curve, slope)
    # The gap between the sides holds the quantile; take the middle between its neighbours.
    strength = np.sort(x @ weights)
    bad = len(worse)
    return Ranking(mean, scale, weights, float((strength[bad - 1] + strength[bad]) / 2))


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most about ``fit_rows`` labelled doc_ids, chosen by a hash; of rows that
    share one the least features count, so that as many rows as ids reach the driver."""
    marks = labels.where(f"{label} IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_good")).withColumn("_id", F.col("_id").cast("long"))
    share = min(1.0, fit_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in words.slices(batch.column("text")):
                rows = [x.tobytes() for x in text_features(texts)]
                own = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([own.column("_id"), own.column("_good"), pa.array(rows, pa.binary())], names=["id", "good", "features"])
                at += len(texts)

    found = docs.join(checked_broadcast(marks), F.col("doc_id") == F.col("_id")).select("_id", "_good", "text").mapInArrow(run, "id long, good int, features binary")
    found = found.groupBy("id", "good").agg(F.min("features").alias("features")).drop("id").toArrow()
    # In an order of their own, so that the pairs don't depend on how the rows arrive.
    found = found.sort_by([("features", "ascending"), ("good", "ascending")])
    rows = np.frombuffer(b"".join(x.as_py() for x in found.column("features")), np.float32).reshape(-1, FEATURES)
    return rows, found.column("good").to_numpy() == 1


def held_out(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document; held-out labels are never learned."""
    texts = docs.select("doc_id", "text")
    training = texts.where(~held_out(F.col("doc_id")))
    model = fit_ranking(*labelled_features(training, labels, label, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in words.slices(batch.column("text")):
                own = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(model.score(text_features(part)), pa.float64())], names=["doc_id", "held_out", "score"])
                at += len(part)

    scored = texts.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
