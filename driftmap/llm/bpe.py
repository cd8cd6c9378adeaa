"""Token ids of a column of texts with the ``tokenizers`` library.

A text is cut at places where the tokenizer's own rules always cut (``piece_starts``): round the strings
of its added tokens, before a blank that leads a word, round a single newline between words, and between
ASCII letters and punctuation.  Most pieces of a corpus repeat, so the pieces of a megabyte are told
apart by their bytes, each distinct one is encoded once, many in one call and apart by newlines, and
short ones are remembered (``Known``); the ids of all texts are put together by array indexing.
The result is the same as encoding each text whole; the tests hold it against that.

Memory doesn't depend on the corpus: a task holds a slice of texts (``words.SLICE_BYTES``, or one longer
text) with its ids, the temporaries of ``BLOCK`` bytes, and at most ``REMEMBERED`` pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from driftmap.llm import words

#: Text bytes whose distinct pieces are encoded together.
BLOCK = 1_000_000
#: Bytes of distinct pieces in one call.
CALL_BYTES = 64_000
#: Pieces that a worker remembers, and the longest of them (``words.keyed`` hashes those in numpy).
REMEMBERED, SHORT = 600_000, words.LONG

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Bytes that may begin a white-space character beyond ASCII.
_UNSURE = np.zeros(256, bool)
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SOLID = ~_BLANK & ~_UNSURE
_ASCII = np.arange(256) < 128
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = _MARK[39] = False
_MARK &= ~_LETTER


class Known:
    """Pieces with their ids, as arrays: some sixty bytes a piece.  Keyed hashes lead to a piece's place, where
    its bytes are compared."""

    def __init__(self):
        self.key = words.new_key(1)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        #: Bytes and ids of the pieces one behind another, with some room, and where each piece's begin.
        self.names, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u4")
        self.name_starts, self.id_starts = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def hashed(self, pieces: pa.Array) -> np.ndarray:
        return words.keyed(pieces, self.key)[0]

    def find(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each of ``pieces``, none empty, or -1."""
        if not len(self.hashes):
            return np.full(len(pieces), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        data, offsets = words.raw(pieces)
        place, sizes, out = self.places[at], np.diff(offsets), np.full(len(pieces), -1)
        own = np.flatnonzero((self.hashes[at] == hashes) & (self.name_starts[place + 1] - self.name_starts[place] == sizes))
        if len(own):
            same = gather(self.names, self.name_starts[place[own]], sizes[own]) == gather(data, offsets[own], sizes[own])
            own = own[np.add.reduceat(same, np.cumsum(sizes[own]) - sizes[own], dtype=np.int64) == sizes[own]]
            out[own] = place[own]
        return out

    def add(self, pieces: pa.Array, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(self.hashes) + len(pieces) > REMEMBERED:
            self.clear()
        data, offsets = words.raw(pieces)
        place = np.arange(len(self.hashes), len(self.hashes) + len(pieces), dtype=np.int32)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.places = np.insert(self.hashes, at, hashes[order]), np.insert(self.places, at, place[order])
        self.names = _appended(self.names, int(self.name_starts[-1]), data)
        self.ids = _appended(self.ids, int(self.id_starts[-1]), ids)
        self.name_starts = np.append(self.name_starts, self.name_starts[-1] + offsets[1:])
        self.id_starts = np.append(self.id_starts, self.id_starts[-1] + np.cumsum(counts))


def _appended(values: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``values`` with ``more`` behind the first ``used``, and with room behind that."""
    if used + len(more) > len(values):
        larger = np.empty((used + len(more)) * 3 // 2, values.dtype)
        larger[:used] = values[:used]
        values = larger
    values[used : used + len(more)] = more
    return values


class Encoder:
    """A tokenizer with what it knows of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.newline = self.tokenizer.token_to_id("Ċ")
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Added tokens that take blanks round them, or not every occurrence: no cuts then.
        self.whole = any(t.lstrip or t.rstrip or t.single_word or "\n" in t.content for t in added)
        strings = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        self.known = Known()

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count): the ids of piece k are ``ids[first[k] : first[k] + count[k]]``."""
        known, sizes = self.known, np.asarray(pc.binary_length(pieces), np.int64)
        short = np.flatnonzero(sizes <= SHORT)
        brief = pieces.take(pa.array(short))
        hashes = known.hashed(brief)
        place = np.full(len(pieces), -1)
        place[short] = known.find(brief, hashes)
        old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        count = np.zeros(len(pieces), np.int64)
        begin = known.id_starts[place[old]]
        count[old] = known.id_starts[place[old] + 1] - begin
        remembered = gather(known.ids, begin, count[old])
        fresh, count[new] = self.encoded(pieces.take(pa.array(new)))
        first = np.zeros(len(pieces), np.int64)
        order = np.concatenate([old, new])
        first[order] = np.cumsum(count[order]) - count[order]
        kept = place[short] < 0
        if kept.any():
            which = short[kept]
            known.add(pieces.take(pa.array(which)), hashes[kept], gather(fresh, first[which] - len(remembered), count[which]), count[which])
        return np.concatenate([remembered, fresh]), first, count

    def encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``pieces`` one behind another, and their number for each, all by the tokenizer.
        Pieces without blanks, but for one in front, are encoded together, each with a newline behind it."""
        data, offsets = words.raw(pieces)
        odd = np.concatenate(([0], np.cumsum(_BLANK[data] | _UNSURE[data])))
        starts, ends = offsets[:-1], offsets[1:]
        lead = (data[starts] == 32).astype(np.int64) if len(starts) else starts
        plain = (odd[ends] == odd[starts + lead]) & (ends > starts + lead) & (self.newline is not None)
        # One call at a time: an encoding takes far more memory than its ids.
        call = lambda x: np.array(self.tokenizer.encode_batch_fast([x.tobytes().decode()], add_special_tokens=False)[0].ids, "<u4")
        parts, counts = [np.zeros(0, "<u4")], np.zeros(len(pieces), np.int64)
        breaks = np.append(np.flatnonzero(~plain), len(pieces))
        at = 0
        while at < len(pieces):
            to = at + 1
            if plain[at]:
                # Up to the next piece that isn't plain, or CALL_BYTES.
                to = max(to, min(int(breaks[np.searchsorted(breaks, at)]), int(np.searchsorted(ends, starts[at] + CALL_BYTES))))
                found = call(np.insert(data[starts[at] : ends[to - 1]], ends[at:to] - starts[at], 10))
                marks = np.flatnonzero(found == self.newline)
                if len(marks) == to - at:
                    counts[at:to] = np.diff(marks, prepend=-1) - 1
                    parts.append(np.delete(found, marks))
                    at = to
                    continue
            for k in range(at, to):
                parts.append(call(data[starts[k] : ends[k]]))
                counts[k] = len(parts[-1])
            at = to
        return np.concatenate(parts), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def added_spans(pattern: re.Pattern | None, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Where ``pattern`` occurs in the texts that ``offsets`` mark in ``data``; never across texts."""
    if pattern is None or not pattern.search(memoryview(data)):
        return []
    edges = np.unique(offsets).tolist()
    return [(m.start() + a, m.end() + a) for a, b in zip(edges, edges[1:]) for m in pattern.finditer(memoryview(data[a:b]))]


def piece_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Is there the start of a piece, for each byte of ``data``; ``first`` marks those that surely are."""
    n = len(data)
    inner = ~first[1:]
    start = first.copy()
    solid, blank, letter, mark = _SOLID[data], data == 32, _LETTER[data], _MARK[data]
    start[:-1] |= blank[:-1] & solid[1:] & inner
    start[1:] |= ((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) & inner
    if n > 2:
        lone = (data[1:-1] == 10) & solid[:-2] & _ASCII[data[:-2]] & solid[2:] & inner[:-1] & inner[1:]
        start[1:-1] |= lone
        start[2:] |= lone
    return start


def pieces(found: Encoder, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The edges of consecutive pieces, about BLOCK bytes at a time: the last edge of one array is the
    first of the next."""
    n, spans = len(data), added_spans(found.added, data, offsets)
    marks = np.unique(np.concatenate([offsets[offsets < n], *(np.array(s, np.int64) for s in spans)]))
    marks, last = marks[marks < n], 0
    for at in range(0, n, BLOCK):
        low, high = max(0, at - 2), min(n, at + BLOCK + 2)  # whether a byte starts a piece shows within two bytes
        first = np.zeros(high - low, bool)
        first[marks[np.searchsorted(marks, low) : np.searchsorted(marks, high)] - low] = True
        start = first if found.whole else piece_starts(data[low:high], first)
        own = np.flatnonzero(start[at - low : at - low + BLOCK]) + at
        for a, b in spans:
            if a < at + BLOCK and b > at:
                own = own[(own <= a) | (own >= b)]
        if len(own) and own[-1] > last:
            edges = own if own[0] == last else np.concatenate(([last], own))
            last = own[-1]
            yield edges
    yield np.array([last, n])


def gather(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[first : first + count]`` one behind another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first - ends + counts, counts) + np.arange(total)]


def encode(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``texts`` one behind another, and their number for each text."""
    data, offsets = words.raw(texts)
    found, parts, total, upto = encoder(path), [], 0, np.zeros(len(offsets), np.int64)
    for edges in pieces(found, data, offsets) if len(data) else ():
        own = words.runs_by_value(data, edges)
        ids, first, counts = found.ids(own.dictionary)
        which = own.indices.to_numpy()
        parts.append(gather(ids, first[which], counts[which]))
        reached = total + np.concatenate(([0], np.cumsum(counts[which])))
        a, b = np.searchsorted(offsets, edges[0]), np.searchsorted(offsets, edges[-1])
        upto[a:b] = reached[np.searchsorted(edges, offsets[a:b])]
        total = int(reached[-1])
        upto[b:] = total
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.diff(upto)


def encoded_groups(path: str, batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows of ``batch``, ids, counts) for consecutive rows, a slice of texts at a time."""
    at = 0
    for texts in words.slices(batch.column(column)):
        yield (batch.slice(at, len(texts)), *encode(path, texts))
        at += len(texts)
    words.give_back()
