import hashlib
import random
import zlib

import numpy as np
import pytest

from driftmap.llm import media


def filtered(pixels, kinds):
    """Rows of a PNG with the given filters, pixel by pixel from the definitions."""
    rows = []
    for y, kind in enumerate(kinds):
        row = [kind]
        for x in range(pixels.shape[1]):
            a = int(pixels[y, x - 1]) if x else 0
            b = int(pixels[y - 1, x]) if y else 0
            c = int(pixels[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            row.append((int(pixels[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        rows.append(row)
    return np.array(rows, np.uint8)


def test_all_filters_are_undone():
    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    kinds = [*range(5), 4, 3, *rng.integers(0, 5, 33).tolist()]
    assert (media.unfilter(filtered(pixels, kinds)) == pixels).all()
    for kind in range(5):  # one run, taller and wider than the other side
        for shape in ((40, 64), (70, 3), (1, 9), (9, 1)):
            part = rng.integers(0, 256, shape, dtype=np.uint8)
            assert (media.unfilter(filtered(part, [kind] * shape[0])) == part).all()


def test_round_trip_and_damage():
    rng = np.random.default_rng(6)
    pixels = rng.integers(90, 110, (500, 64), dtype=np.uint8)
    image = media.encode_png(pixels)
    assert (media.decode_png(image) == pixels).all()
    for at in (3, 20, 60, len(image) - 2):
        bad = bytearray(image)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(image[:-12])


def test_hash_of_a_transform_by_definition():
    rng = np.random.default_rng(7)
    pixels = rng.integers(0, 256, (32, 32), dtype=np.uint8)
    want = [[sum(int(pixels[y, x]) * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    bits = "".join("1" if v > np.median(np.ravel(want)[1:]) else "0" for v in np.ravel(want))
    assert media.dct_hash(pixels) == f"{int(bits, 2):016x}"


def test_query_columns(spark):
    texts = [None, "", "a", "é" * 32, "x" * 63, "y" * 64, "z" * 65, "lorem ipsum " * 9000, "a", "".join(map(chr, random.Random(1).sample(range(32, 5000), 3000)))]
    rows = [(i if i != 8 else None, t, "clash") for i, t in enumerate(texts)]
    got = media.media_features(spark.createDataFrame(rows, "doc_id long, text string, media string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw)) % 64) if raw else bytes(64)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[2].feature == by[None].feature and by[2].media_sha256 == by[None].media_sha256
    assert media.media_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_stream_without_header_is_refused():
    with pytest.raises(ValueError, match="no image header"):
        media.decode_png(media.SIGNATURE + media.chunk(b"IDAT", b"") + media.chunk(b"IEND", b""))


def test_columns_that_clash(spark):
    rows = [(1, "abc", 7, b"x", "f"), (2, None, 7, b"x", "f"), (None, "abc", 7, b"x", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, media binary, feature string")
    got = {r.doc_id: r for r in media.media_features(df).collect()}
    assert got[1].n_bytes == 3 and got[2].n_bytes == 0 and got[None].feature == got[1].feature and len(got) == 3
    assert media.media_features(df.where("false")).count() == 0
