"""Packing token sequences into fixed windows by best-fit decreasing.

Documents are tokenised where they are read.  A document longer than a window is first cut into full
windows; what is left over, a tail shorter than a window, is packed with others.  Only piece lengths
are packed, never tokens.  Tails are dealt by a hash over bins of about ``BIN_ROWS`` pieces, a
number that doesn't grow with the input, so packing runs in as many tasks as there are bins; the cost
is one half-filled window a bin.  In a bin the longest tail goes first, each into the open window
with the least room that still holds it.  A segment tree over remaining capacities finds that window
in as many steps as the window's size has bits.

Defined cases: a null or empty text has one token, the end id; repeated rows are separate documents;
an empty table gives no pieces; other columns are ignored.  A task holds the ids of its longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.llm import bpe
from driftmap.sources.scratch import materialize

WINDOW = 2048
BIN_ROWS = 20_000


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaves are the capacities."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.some = bytearray(2 * self.leaves)  # is there an open window below this node
        self.stacks: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        node = room + self.leaves
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with at least ``need`` room, removed."""
        node = need + self.leaves
        if not self.some[node]:
            # Up to the first right sibling that has a window, then down its leftmost path.
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.stacks[room].pop()
        if not self.stacks[room]:
            self.some[node] = 0
            while node > 1:
                node >>= 1
                if self.some[2 * node] or self.some[2 * node + 1]:
                    break
                self.some[node] = 0
        return room, window


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each of ``lengths``, which are in decreasing order."""
    open_windows, made, numbers, offsets = OpenWindows(window), 0, [], []
    for n in lengths:
        found = open_windows.take(n)
        if found:
            room, number = found
        else:
            room, number, made = window, made, made + 1
        numbers.append(number)
        offsets.append(window - room)
        if room > n:
            open_windows.add(room - n, number)
    return numbers, offsets


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """_row, doc_id, start, length, ids_crc32, doc_tokens: each document cut into full windows and a tail."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, counts in bpe.encoded_groups(tokenizer_path, batch):
                ends = np.cumsum(counts)
                out: list[list[int]] = [[], [], [], [], []]
                for k, (end, count) in enumerate(zip(ends.tolist(), counts.tolist())):
                    own = np.append(ids[end - count : end], end_id).astype("<u4")
                    for start in range(0, count + 1, window):
                        part = own[start : start + window]
                        for column, x in zip(out, (k, start, len(part), zlib.crc32(part.tobytes()), count + 1)):
                            column.append(x)
                which = pa.array(out[0], pa.int64())
                columns = [rows.column("_row").take(which), rows.column("doc_id").take(which), *(pa.array(x, pa.int64()) for x in out[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(cut, "_row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_pieces(pieces: DataFrame, window: int = WINDOW, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; pieces of one window never overlap."""
    pieces = materialize(pieces, "pieces")
    bins = max(1, -(-pieces.count() // bin_rows))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "_row"], ascending=[False, True, True, True], kind="stable")
        numbers, offsets = best_fit(part["length"].tolist(), window)
        part["sequence_id"] = part["_bin"].astype("int64") * 2**32 + np.array(numbers, np.int64)
        part["offset"] = np.array(offsets, np.int64)
        return part

    dealt = pieces.withColumn("_bin", F.pmod(F.xxhash64("_row", "start"), F.lit(bins)))
    schema = pieces.schema.simpleString()[7:-1]
    packed = dealt.groupBy("_bin").applyInPandas(fill, f"{schema.replace(':', ' ')}, _bin long, sequence_id long, offset long".replace(",", ", "))
    return packed.drop("_bin")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, bin_rows: int = BIN_ROWS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece.

    Every id of every document lies in exactly one piece, every piece in exactly one sequence of at
    most ``window`` tokens; a document's last id is ``end_id``.
    """
    packed = pack_pieces(token_pieces(docs, tokenizer_path, end_id, window), window, bin_rows)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
