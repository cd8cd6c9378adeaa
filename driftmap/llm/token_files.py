"""Token ids in Arrow files of fixed-size lists, and the way back.

Documents are range-partitioned and sorted by doc_id; each task encodes its own and writes two Arrow files
in the shared folder.  (Encoding before the shuffle would move ids instead of texts, but the ids must
then be written as well, as a range partitioning reads its input twice.)

* ``*.tokens.arrow``: the ids of the task's documents one behind another, cut into sequences of
  ``length``: ``input_ids`` fixed_size_list<uint16 or uint32>, ``mask`` fixed_size_list<bool> (false
  for the padding behind the last id).  Record batches have ``BATCH`` sequences each, so sequence i
  is row i % BATCH of batch i // BATCH, found in a memory map without a copy.
* ``*.docs.arrow``: doc_id, start (in this file) and n_tokens of each document.

A file is written under another name and renamed when complete, so a task that is run again, after
the loss of an executor or in a speculative copy, leaves the same file.

Defined cases: a null or empty text has one token, the end id; null doc_ids come last; rows with the
same doc_id are separate documents, in the order they are read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmap.llm import bpe
from driftmap.sources.scratch import materialize, scratch_path

LENGTH = 2048
BATCH = 64
ROWS_PER_FILE = 8192
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def token_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Ids as they come, cut into sequences and written in whole record batches."""

    def __init__(self, sink, length: int, kind: pa.DataType):
        self.length, self.kind, self.schema = length, kind, token_schema(length, kind)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.total = self.held = 0

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind.to_pandas_dtype()))
        self.held += len(ids)
        self.total += len(ids)
        size = self.length * BATCH
        if self.held >= size:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // size * size
            for at in range(0, whole, size):
                self.write(ids[at : at + size], size)
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind.to_pandas_dtype())
        if len(ids):
            self.write(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.file.close()


def largest_id(tokenizer_path: str, end_id: int) -> int:
    return max(end_id, *bpe.encoder(tokenizer_path).tokenizer.get_vocab(with_added_tokens=True).values())


def narrowest(tokenizer_path: str, end_id: int) -> pa.DataType:
    """The type of the ids in the files: uint32 where one doesn't fit 16 bits."""
    return pa.uint32() if largest_id(tokenizer_path, end_id) >> 16 else pa.uint16()


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, length: int = LENGTH, kind: pa.DataType | None = None, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write the files below ``folder``; returns (part, path, docs, tokens), a row for each file pair."""
    kind = kind or narrowest(tokenizer_path, end_id)
    if largest_id(tokenizer_path, end_id) >> kind.bit_width:
        raise ValueError(f"{kind} doesn't hold every id of the tokenizer and {end_id}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, own = f"{root}/part-{part:06d}", uuid.uuid4().hex
        tokens = index = None
        count = 0
        for batch in batches:
            for rows, ids, counts in bpe.encoded_groups(tokenizer_path, batch):
                if tokens is None:
                    streams = [fs.open_output_stream(f"{name}.{own}.{k}") for k in ("tokens", "docs")]
                    tokens, index = SequenceWriter(streams[0], length, kind), pa.ipc.new_file(streams[1], DOCS)
                ends = np.cumsum(counts)
                starts = tokens.total + ends - counts + np.arange(len(counts))
                tokens.append(np.insert(ids, ends, end_id))
                index.write_batch(pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(starts), pa.array(counts + 1)], schema=DOCS))
                count += len(counts)
        if tokens is not None:
            tokens.close()
            index.close()
            for stream, k in zip(streams, ("tokens", "docs")):
                stream.close()
                fs.move(f"{name}.{own}.{k}", f"{name}.{k}.arrow")
            out = [[part], [f"{folder}/part-{part:06d}"], [count], [tokens.total]]
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "path", "docs", "tokens"), out)))

    files = max(1, -(-docs.count() // rows_per_file))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("_row")]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(dealt.mapInArrow(write, "part long, path string, docs long, tokens long"), "token-files")


def open_arrow(uri: str):
    """A record batch reader over ``uri``; local files are mapped, not read."""
    fs, path = pafs.FileSystem.from_uri(uri)
    source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
    return pa.ipc.open_file(source)


def sequence(uri: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of the i-th sequence of a token file; the ids are a view into the file."""
    reader = open_arrow(uri)
    batch = reader.get_batch(i // BATCH)
    length = batch.schema.field("input_ids").type.list_size
    at = i % BATCH * length
    flat = batch.column("input_ids").flatten().slice(at, length)
    return flat.to_numpy(zero_copy_only=True), batch.column("mask").flatten().slice(at, length).to_numpy(zero_copy_only=False)


def file_documents(path: str) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """The document batches of a file pair, with the crc32 of each document's ids as they are in the file."""
    reader, index = open_arrow(f"{path}.tokens.arrow"), open_arrow(f"{path}.docs.arrow")
    block, ids, at = 0, np.zeros(0, np.uint16), 0  # ids: the block that holds token ``at``, from there on
    for b in range(index.num_record_batches):
        docs, crcs = index.get_batch(b), []
        for left in docs.column("n_tokens").to_pylist():
            crc = 0
            while left:
                if at == len(ids):
                    ids, at, block = reader.get_batch(block).column("input_ids").flatten().to_numpy(), 0, block + 1
                part = ids[at : at + left]
                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                at, left = at + len(part), left - len(part)
            crcs.append(crc)
        yield docs, crcs


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents of the files in ``manifest``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                for docs, crcs in file_documents(path):
                    columns = [docs.column("doc_id"), pa.array(docs.column("start").to_numpy() + base), docs.column("n_tokens"), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a file pair: this window sees files, never documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("part", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    parts = max(1, manifest.count())
    return based.repartition(parts, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, **options) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read every document back from them."""
    return read_tokens(write_tokens(docs, tokenizer_path, scratch_path(docs.sparkSession, "tokens"), end_id, **options))
