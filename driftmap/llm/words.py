"""Words and shingles of a column of texts as numpy arrays.

An Arrow string array is one run of UTF-8 bytes with offsets, so words and the shingles of a whole slice
of rows come from a few array operations.  Words are runs of anything but ASCII white space, or but
the bytes that the caller names; A-Z count as a-z.  The words of a slice are told apart by their bytes.

Where words must be told apart across tasks they get 64-bit hashes under a secret key that the driver
draws anew for each run (``new_key``): SipHash-2-4 for each of several lanes, longer words through a keyed
BLAKE2b first.  A shingle is the sum of its words' hashes, each from the lane of its place in the shingle,
so two shingles that differ anywhere differ by an independent uniform number: they are taken for one with
a probability of 2^-64, whoever chose the texts.

A text is never cut: a task holds its longest text, and takes about twenty times its size for it.
"""

from __future__ import annotations

import ctypes
import secrets
from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at a time; the temporaries take about twenty times as much.
SLICE_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers outlive their tasks, and
    several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def new_key(lanes: int) -> np.ndarray:
    """A secret key of 128 bits for each of ``lanes``."""
    return np.frombuffer(secrets.token_bytes(16 * lanes), np.uint64).reshape(lanes, 2)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of ``texts`` of about ``most`` bytes; a longer text is a slice of its own."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of ``texts``; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def siphash(blocks: np.ndarray, key: np.ndarray) -> np.ndarray:
    """SipHash-2-4 (Aumasson and Bernstein, 2012) of each row of ``blocks`` (the last has the length)."""
    # The initial state.
    v = [np.full(len(blocks), key[k % 2] ^ np.uint64(c)) for k, c in enumerate((0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573))]

    def rounds(many: int) -> None:
        for _ in range(many):
            v[0] += v[1]
            v[2] += v[3]
            v[1], v[3] = _rotated(v[1], 13) ^ v[0], _rotated(v[3], 16) ^ v[2]
            v[0] = _rotated(v[0], 32) + v[3]
            v[2] += v[1]
            v[3], v[1] = _rotated(v[3], 21) ^ v[0], _rotated(v[1], 17) ^ v[2]
            v[2] = _rotated(v[2], 32)

    for k in range(blocks.shape[1]):
        v[3] ^= blocks[:, k]
        rounds(2)
        v[0] ^= blocks[:, k]
    v[2] ^= np.uint64(0xFF)
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


#: Longer values are hashed through BLAKE2b.
LONG = 55


def keyed(values: pa.Array, key: np.ndarray) -> np.ndarray:
    """(lanes, values) hashes of ``values`` (bytes) under ``key``."""
    data, offsets = raw(values)
    sizes = np.diff(offsets)
    out = np.empty((len(key), len(values)), np.uint64)
    data = np.append(data, np.zeros(LONG + 1, np.uint8))
    blocks = np.where(sizes > LONG, 0, sizes // 8 + 1)
    for many in np.unique(blocks).tolist():
        own = np.flatnonzero(blocks == many)
        if many:
            place = np.arange(8 * many)
            rows = data[offsets[own, None] + place] * (place < sizes[own, None])
            rows[:, -1] = sizes[own]
        else:  # 32 bytes and a length that no short value has
            rows = np.zeros((len(own), 40), np.uint8)
            secret = key.tobytes()[:64]
            rows[:, :32] = np.frombuffer(b"".join([blake2b(x, digest_size=32, key=secret).digest() for x in values.take(pa.array(own)).to_pylist()]), np.uint8).reshape(-1, 32)
            rows[:, -1] = 255
        for lane, k in enumerate(key):
            out[lane, own] = siphash(np.ascontiguousarray(rows).view("<u8"), k)
    return out


def runs_by_value(data: np.ndarray, edges: np.ndarray) -> pa.DictionaryArray:
    """The runs of ``data`` between neighbouring ``edges``, each as the number of its value; equal bytes,
    and only they, get equal numbers."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, buffers).dictionary_encode()


class Words:
    """The words of a slice of texts in order: ``code`` (place in ``names``, its distinct words) and ``doc``
    (row in the slice) of each."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE):
        self.data, self.offsets = raw(texts)
        self.rows = len(texts)
        # A row's first byte may start a word, whatever the row before ends with.
        head = np.zeros(len(self.data) + 1, bool)
        head[self.offsets] = True
        word = ~separators[self.data]
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        self.starts = np.flatnonzero(word & (~before | head[:-1]))
        self.ends = np.flatnonzero(word & (~after | head[1:])) + 1
        # The runs are words and what is between them in turn.
        runs = runs_by_value(LOWER[self.data], np.stack([self.starts, self.ends], axis=1).ravel()) if len(self.starts) else None
        self.names = runs.dictionary if runs else pa.array([], pa.large_binary())
        self.code = runs.indices.to_numpy()[::2] if runs else np.zeros(0, np.int32)
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, key: np.ndarray) -> np.ndarray:
        """(lanes, words): each word's hash in each lane of ``key``."""
        return keyed(self.names, key)[:, self.code]


def shingles(words: Words, n: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of every run of ``n`` words; a text with fewer words is one shingle.  ``key`` has n lanes."""
    doc, many = words.doc, len(words.code)
    if not many:
        return np.zeros(0, np.uint64), doc
    by_name = keyed(words.names, key)
    left = np.repeat(np.cumsum(words.counts), words.counts) - np.arange(many)  # words to the end of the text
    whole = (left >= n) | (left == words.counts[doc])
    out = by_name[0][words.code]
    for k in range(1, n):
        part = np.zeros(many, np.uint64)
        part[: many - k] = by_name[k][words.code[k:]]
        part[left <= k] = 0
        out += part
    return out[whole], doc[whole]
