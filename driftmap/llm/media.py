"""Media columns: PNG images as binary values, decoded and hashed inside Spark tasks.

``encode_png`` and ``decode_png`` speak 8-bit greyscale PNG: a signature, then chunks of length, type,
data and a CRC-32 over type and data; the pixel rows are filtered and zlib-compressed in IDAT chunks.
The decoder tests every checksum (chunk CRCs and zlib's Adler-32) and undoes all five row filters
with numpy.  ``dct_hash`` is a perceptual hash: an area average to 32 x 32, a two-dimensional cosine
transform, and one bit for each of the 8 x 8 lowest frequencies: is it above their median.

Defined cases: a null text is empty; an empty payload gets one row of 64 zero bytes; equal texts give
equal values; any damage to a stored image raises ``ValueError``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftmap.llm import words
from driftmap.sources.scratch import materialize

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 64
CHUNK_BYTES = 1 << 20


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """A greyscale PNG of a (height, width) uint8 array, each row with the filter, of none, left and
    up, that leaves the least sum of absolute differences."""
    height, width = pixels.shape
    left, up = pixels.copy(), pixels.copy()
    left[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    options = np.stack([pixels, left, up])
    cost = np.minimum(options, 0 - options).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = options[best, np.arange(height)]
    data = zlib.compress(rows.tobytes(), level)
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    body = b"".join(chunk(b"IDAT", data[at : at + CHUNK_BYTES]) for at in range(0, len(data), CHUNK_BYTES))
    return SIGNATURE + chunk(b"IHDR", header) + body + chunk(b"IEND", b"")


def chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, data) of each chunk; the checksums must hold and the last chunk must be IEND."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kind = 8, b""
    while at + 12 <= len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data, crc = image[at + 8 : at + 8 + size], image[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + data):
            raise ValueError(f"bad checksum in chunk {kind!r}")
        yield kind, data
        at += 12 + size
    if kind != b"IEND" or at != len(image):
        raise ValueError("truncated PNG")


def undo_by_diagonals(rows: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """Pixels of ``rows`` that all have the filter AVERAGE or PAETH, below the pixels ``above``.  A pixel
    rests on its left, upper and upper left neighbours, so a whole diagonal is undone at once."""
    height, width = rows.shape
    framed = np.zeros((height + 1, width + 1), np.int16)
    framed[0, 1:], framed[1:, 1:] = above, rows
    for d in range(height + width - 1):
        x = np.arange(max(0, d - height + 1), min(width, d + 1))
        y = d - x
        west, north, corner = framed[y + 1, x], framed[y, x + 1], framed[y, x]
        if kind == AVERAGE:
            guess = (west + north) // 2
        else:  # whichever neighbour is nearest to west + north - corner, in this order
            far = [np.abs(north - corner), np.abs(west - corner), np.abs(west + north - 2 * corner)]
            guess = np.choose(np.argmin(far, axis=0), [west, north, corner])
        framed[y + 1, x + 1] = (framed[y + 1, x + 1] + guess) & 255
    return framed[1:, 1:].astype(np.uint8)


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Pixels from filtered rows (height, 1 + width).  Runs of rows with the same filter are undone at
    once: of none, left or up by running sums modulo 256, the other two by diagonals."""
    kinds, pixels = rows[:, 0], rows[:, 1:].copy()
    edges = np.concatenate(([0], np.flatnonzero(np.diff(kinds)) + 1, [len(rows)]))
    for a, b in zip(edges[:-1], edges[1:]):
        kind = kinds[a] if b > a else NONE
        above = pixels[a - 1] if a else np.zeros(pixels.shape[1], np.uint8)
        if kind == SUB:
            pixels[a:b] = np.cumsum(pixels[a:b], axis=1, dtype=np.uint8)
        elif kind == UP:
            pixels[a:b] = np.cumsum(np.vstack([above[None], pixels[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (AVERAGE, PAETH):
            pixels[a:b] = undo_by_diagonals(pixels[a:b], above, kind)
        elif kind != NONE:
            raise ValueError(f"unknown filter {kind}")
    return pixels


def decode_png(image: bytes) -> np.ndarray:
    """The (height, width) uint8 pixels of an 8-bit greyscale PNG without interlacing."""
    header, data = b"", []
    for kind, part in chunks(image):
        if kind == b"IHDR":
            header = part
        elif kind == b"IDAT":
            data.append(part)
    if len(header) != 13:
        raise ValueError("no image header")
    width, height, *form = struct.unpack(">IIBBBBB", header)
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("only 8-bit greyscale without interlacing")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(f"bad pixel data: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of pixels")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * np.outer(np.arange(8), 2 * k + 1) / (2 * n))


_COSINES = cosines(32)


def shrink(pixels: np.ndarray, n: int = 32) -> np.ndarray:
    """Area averages over an n x n grid; small images repeat pixels."""
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
    spans = []
    for size in pixels.shape:
        low = np.arange(n) * size // n
        spans.append((low, np.maximum(low + 1, (np.arange(n) + 1) * size // n)))
    (r0, r1), (c0, c1) = spans
    total = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    return total / np.outer(r1 - r0, c1 - c0)


def dct_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: which of the 8 x 8 lowest frequencies lie above their median."""
    low = np.round(_COSINES @ shrink(pixels) @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    """``text`` with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded, as the pixels of a PNG 64 wide."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in words.slices(batch.column("text"), 8_000_000):
                raw = [(x or "").encode() for x in texts.to_pylist()]
                media = [encode_png(np.frombuffer(payload_of(x), np.uint8).reshape(-1, WIDTH)) for x in raw]
                ids = batch.column("doc_id").slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                at += len(texts)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Features of the images in ``stored`` (doc_id, n_bytes, media), all from the stored bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            out: list[tuple] = []
            for image in batch.column("media"):
                image = image.as_py()
                pixels = decode_png(image)
                payload = pixels.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), dct_hash(pixels)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(read, schema)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text as a PNG in a binary column and read the features back from the stored table."""
    return read_media(materialize(encode_texts(docs), "media"))
