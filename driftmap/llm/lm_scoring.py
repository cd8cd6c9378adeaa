"""Cross-entropy difference of two matched n-gram models.

Both models interpolate bigrams and unigrams, with the same weights, add-one floor and vocabulary:
all words of all documents.  (A caller may ask for the ``vocabulary_size`` most frequent words; of
words that tie at that edge none is taken, and everything else is one unknown word.)
Every distinct word and bigram of the corpus keeps its count in either model under a 64-bit hash with a
secret key that each run draws anew (``words.hashes``; a bigram's is the sum of its words', each from a
lane of its own).  Two different ones are counted as one with a probability of 2^-64, whoever chose the
texts.

Counts are gathered by a shuffle.  A slice is up to ``PARTS`` parts of a few megabytes of text, which are read
one after another and whose distinct words and bigrams are merged.  Each slice sends those, sorted and dealt
by key into buckets whose number grows with the text, and gets back the corpus's counts of the same keys
in the same order.  So a key has at most one entry a slice however common it is, and neither the driver nor a
task holds a model.  The parts are then scored by their slice's counts.

A document's score is its loss a word (in nats) under the target model less that under the background
model: the lower, the more it is like the target.

Defined cases: a null or empty text has no words, null losses and a null score; without target
documents the target model is the floor alone; repeated rows count and are scored each; an empty table
gives no rows; other columns are ignored.  A text is in the memory of one task, about twenty times its
size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.llm import words
from driftmap.sources.scratch import materialize

BIGRAM_WEIGHT = 0.6
#: Text bytes of a part, and parts of a slice at most.
PART_BYTES, PARTS = 4_000_000, 8
#: Text bytes of a bucket: the least, and the most beyond FEW_BUCKETS of them.
LEAST_BYTES, MOST_BYTES = 1 << 17, 12 << 20
FEW_BUCKETS = 1024
#: The keys of all words out of the vocabulary and of the place before a text's first word.
UNKNOWN, START = np.uint64(0), np.uint64(0xA0761D6478BD642F)


class Vocabulary:
    """Numbers of words by hash: 1, 2, ... for the vocabulary, 0 for all others."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.size = len(hashes) + 1
        slots = np.searchsorted(self.sorted >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64))
        self.first, self.many = slots[:-1], np.diff(slots)

    def numbers(self, found: np.ndarray) -> np.ndarray:
        slot = (found >> np.uint64(44)).astype(np.int64)
        out = np.zeros(len(found), np.int64)
        for step in range(int(self.many.max()) if len(self.sorted) else 0):
            open_ = np.flatnonzero(self.many[slot] > step)
            at = self.first[slot[open_]] + step
            hit = self.sorted[at] == found[open_]
            out[open_[hit]] = at[hit] + 1
        return out


def word_counts(docs: DataFrame, key: np.ndarray) -> DataFrame:
    """(word, n): the hash of each distinct word of all documents and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in words.slices(batch.column("text")):
                word, n = np.unique(words.Words(texts).hashes(key[:1])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(docs: DataFrame, size: int, key: np.ndarray) -> Vocabulary:
    counts = materialize(word_counts(docs, key), "word-counts")
    top = counts.orderBy(F.col("n").desc()).limit(size + 1).toArrow()  # size + 1 rows
    word, n = top.column("word").to_numpy(), top.column("n").to_numpy()
    return Vocabulary(word[n > n.min()].view(np.uint64) if len(n) > size else word.view(np.uint64))


def sliced(texts: DataFrame) -> DataFrame:
    """(slice, bytes, parts): ``texts`` (doc_id, text, target) in slices, each a list of compressed Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, parts = TaskContext.get().partitionId() << 32, 0, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int64()), "bytes": pa.array([size], pa.int64()), "parts": pa.array([parts], pa.list_(pa.binary()))})

        for batch in batches:
            at = 0
            for part in words.slices(batch.column("text"), PART_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(at, len(part)))
                parts.append(sink.getvalue().to_pybytes())
                size += int(pc.sum(pc.binary_length(part)).as_py() or 0)
                at += len(part)
                if len(parts) == PARTS or size >= PARTS * PART_BYTES:
                    yield row()
                    number, size, parts = number + 1, 0, []
        if parts:
            yield row()

    return materialize(texts.mapInArrow(run, "slice long, bytes long, parts array<binary>"), "slices")


class Part:
    """The distinct words (with START) and bigrams of a part in the order of their keys: ``keys``, the
    place ``at`` of each word and bigram in them, and their ``counts`` in background and target."""

    def __init__(self, rows: pa.Buffer, vocabulary: Vocabulary | None, key: np.ndarray):
        table = pa.ipc.open_stream(rows).read_all().combine_chunks()
        self.doc_id = table.column("doc_id").combine_chunks()
        w = words.Words(table.column("text").combine_chunks())
        self.rows, self.words, doc = w.rows, w.counts, w.doc
        n = len(w.code)
        word, second = w.hashes(key)
        if vocabulary is not None:
            unknown = vocabulary.numbers(word) == 0
            word[unknown] = second[unknown] = UNKNOWN
        first = np.ones(n, bool)
        first[1:] = doc[1:] != doc[:-1]
        before = np.empty_like(word)
        before[1:], before[first] = word[:-1], START
        target = table.column("target").to_numpy()[doc].astype(np.int64)
        single, at = np.unique(np.concatenate([word, np.full(first.sum(), START)]), return_inverse=True)
        pair, pair_at = np.unique(before + second, return_inverse=True)
        self.keys = (single, pair)
        context = np.empty(n, np.int32)
        context[1:] = at[: max(n - 1, 0)]
        context[first] = np.searchsorted(single, START)
        self.at, self.context = (at[:n].astype(np.int32), pair_at.astype(np.int32)), context
        sides = np.concatenate([target, target[first]])
        self.counts = [np.bincount(p + len(k) * s, minlength=2 * len(k)).astype(np.int32).reshape(2, -1) for p, k, s in ((at, single, sides), (pair_at, pair, target))]


def merged(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The distinct ones of several sorted arrays of ``keys``, and the sums of their ``counts`` in background
    and target (32 bits: a slice has less text).  The sort is one that makes use of sorted runs."""
    every = np.concatenate(keys)
    if counts is None:
        every.sort(kind="stable")
        return every[np.append(True, every[1:] != every[:-1])] if len(every) else every, None
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    sums = np.empty((2, len(starts)), np.int32)
    for side in (0, 1):
        own = np.concatenate([c[side] for c in counts])
        sums[side] = np.add.reduceat(own[order], starts) if len(starts) else 0
    return every[starts], sums


def slice_counts(parts: pa.Array, vocabulary: Vocabulary | None, key: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct words and bigrams of a slice, and their counts: a part leaves only its own behind."""
    own = [[], []]
    for x in parts:
        part = Part(x.as_buffer(), vocabulary, key)
        for kind in (0, 1):
            own[kind].append((part.keys[kind], part.counts[kind]))
        del part
    keys, counts = [], []
    for found in own:
        k, c = merged(*map(list, zip(*found)))
        found.clear()
        keys.append(k)
        counts.append(c)
    return keys, counts


class Slice:
    """The parts of a slice, without their counts, and their distinct ``keys``."""

    def __init__(self, parts: pa.Array, vocabulary: Vocabulary | None, key: np.ndarray):
        self.parts = []
        for x in parts:
            self.parts.append(Part(x.as_buffer(), vocabulary, key))
            del self.parts[-1].counts
        self.keys = [merged([p.keys[kind] for p in self.parts])[0] for kind in (0, 1)]


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).reshape(n)


_NAMES = ["slice", "bucket", "n0", "keys0", "counts0", "n1", "keys1", "counts1"]
_KEYS = "slice long, bucket int, n0 int, keys0 binary, counts0 binary, n1 int, keys1 binary, counts1 binary"
_TOTALS = "slice long, bucket int, n0 int, counts0 binary, n1 int, counts1 binary, distinct long, background long, target long"


def slice_keys(slices: DataFrame, buckets: int, shared) -> DataFrame:
    """For each slice and bucket its distinct words (0) and bigrams (1) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, parts in zip(batch.column("slice").to_pylist(), batch.column("parts")):
                found, counts = slice_counts(parts.values, *shared.value)
                of = [((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) for k in found]
                used = np.unique(np.concatenate([y for x in of for y in (x[:1], x[1:][x[1:] != x[:-1]])]))  # a slice reaches few of very many buckets
                ends = [(np.searchsorted(x, used).tolist(), np.searchsorted(x, used, "right").tolist()) for x in of]
                del of
                out: list[tuple] = []
                for at, b in enumerate(used.tolist()):
                    row: list = [number, b]
                    for keys, n, (first, last) in zip(found, counts, ends):
                        part = slice(first[at], last[at])
                        own = keys[part]
                        row += [len(own), packed(np.diff(own, prepend=np.uint64(0))), packed(n[:, part].astype(np.int64).reshape(-1))]
                    out.append(tuple(row))
                del found, counts
                columns = list(zip(*out)) or [()] * len(_NAMES)
                kinds = [pa.int64(), pa.int32(), *[pa.int32(), pa.binary(), pa.binary()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)
                del out, columns
                words.give_back()

    return slices.select("slice", "parts").mapInArrow(run, _KEYS)


def add_bucket(table: pa.Table) -> pa.Table:
    """The corpus's counts of the keys of one bucket, as each slice sent them; the first row also has the
    bucket's distinct words and their sums of counts."""
    out, sums = [table.column("slice"), table.column("bucket")], [0, 0, 0]
    for kind in "01":
        sizes = table.column(f"n{kind}").to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(x.as_buffer(), n), dtype=np.uint64) for x, n in zip(table.column(f"keys{kind}"), sizes)])
        own = np.concatenate([unpacked(x.as_buffer(), 2 * n).view(np.int64).reshape(2, n) for x, n in zip(table.column(f"counts{kind}"), sizes)], axis=1)
        distinct, at = np.unique(keys, return_inverse=True)
        total = np.stack([np.bincount(at, side, len(distinct)).astype(np.int64) for side in own])
        ends = np.cumsum([0, *sizes])
        replies = [packed(np.ascontiguousarray(total[:, at[a:b]]).reshape(-1)) for a, b in zip(ends, ends[1:])]
        out += [table.column(f"n{kind}"), pa.array(replies, pa.binary())]
        if kind == "0":
            plain = (distinct != START) & (distinct != UNKNOWN)
            sums = [int(plain.sum()), *(int(x) for x in total[:, distinct != START].sum(axis=1))]
    out += [pa.array([x, *[0] * (len(table) - 1)], pa.int64()) for x in sums]
    return pa.Table.from_arrays(out, names=[x.split()[0] for x in _TOTALS.split(", ")])


def cross_entropy_difference(docs: DataFrame, vocabulary_size: int | None = None) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score of ``docs`` (doc_id, text, target).

    The background is all documents that aren't target.
    """
    spark = docs.sparkSession
    slices = sliced(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("target", F.lit(False)).alias("target")))
    size = slices.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(min(FEW_BUCKETS, size // LEAST_BYTES + 1), size // MOST_BYTES)
    key = words.new_key(2)
    shared = spark.sparkContext.broadcast((None if vocabulary_size is None else most_frequent(docs, vocabulary_size, key), key))
    totals = materialize(slice_keys(slices, buckets, shared).groupBy("bucket").applyInArrow(add_bucket, _TOTALS), "lm-counts")
    distinct, *sums = (x or 0 for x in totals.agg(F.sum("distinct"), F.sum("background"), F.sum("target")).first())
    floor = distinct + 1  # and the unknown word

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        s = Slice(rows.column("parts")[0].values, *shared.value)
        found = found.sort_by("bucket")
        totals = [np.concatenate([np.zeros((2, 0), np.int64), *(unpacked(x.as_buffer(), 2 * m).view(np.int64).reshape(2, m) for x, m in zip(found.column(f"counts{k}"), found.column(f"n{k}").to_pylist()))], axis=1) for k in "01"]
        out = []
        for part in s.parts:
            single, pair = (total[:, np.searchsorted(keys, own)] for total, keys, own in zip(totals, s.keys, part.keys))
            n = part.words.astype(np.float64)
            doc = np.repeat(np.arange(part.rows), part.words)
            losses = []
            for side in (1, 0):
                alone = (single[side][part.at[0]] + 1.0) / (sums[side] + floor)
                both = np.minimum(pair[side][part.at[1]] / np.maximum(single[side][part.context], 1), 1.0)
                losses.append(np.bincount(doc, -np.log(BIGRAM_WEIGHT * both + (1 - BIGRAM_WEIGHT) * alone), part.rows) / np.maximum(n, 1))
            none = n == 0
            columns = [part.doc_id, pa.array(part.words.astype(np.int64)), *(pa.array(x, mask=none) for x in (*losses, losses[0] - losses[1]))]
            out.append(pa.Table.from_arrays(columns, names=["doc_id", "n_words", "target_loss", "background_loss", "score"]))
        words.give_back()
        return pa.concat_tables(out)

    counts = totals.select("slice", "bucket", "n0", "counts0", "n1", "counts1").groupBy("slice")
    return slices.select("slice", "parts").groupBy("slice").cogroup(counts).applyInArrow(score, "doc_id long, n_words long, target_loss double, background_loss double, score double")
