import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftmap.llm import bpe, packing, token_files
from driftmap.sources.scratch import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, length string, _row string"
THUE = ["a"]
for _ in range(12):
    THUE.append(THUE[-1] + THUE[-1].translate(str.maketrans("ab", "ba")))
#: Words of a and b that polynomial hashes modulo a power of two take for one another.
TWINS = [t for n in (10, 11, 12) for t in (THUE[n], THUE[n].translate(str.maketrans("ab", "ba")))]
SPECIAL = ["<|endoftext|> hi", "a <|endoftext|>b<|endoftext|><|endoftext|>", "<|endof", "text|> <|endoftext|", ">x", "<|endoftext|>"]
ODD = [*TWINS, *SPECIAL, "", None, "a  b", "a   b\n\n c\n d\ne", "it's, don't!'s 'tis 9,9 x  y　", "x" * 5000, " \n ", "é,b !é\n€, €x\n\u0085y z\x1c w", "'s's''s.'s a'.s", "日本 語,x", "word, " * 3000]


PLAIN = Tokenizer.from_file(PATH)


def reference(text, end):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("block", [7, 50, 1000, bpe.BLOCK])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, block):
    """Also where the cuts between blocks fall anywhere, and with few pieces remembered."""
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(bpe, "REMEMBERED", 100 if block < 1000 else 10_000)
    rng = random.Random(3)
    letters = [" ", "\n", "a", "é", ",", "'", "s", "1", "\t", "😀", "_", "B", "!", "\r", "\x1c", "\x85", "<|endoftext|>", "<|", "endoftext", "|>"]
    texts = ODD[: len(ODD) if block > 100 else -1] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(min(3000, 60 * block))]
    ids, counts = bpe.encode(PATH, pa.array(texts))
    want = [reference(t, 1)[:-1] for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_pieces_are_remembered_beyond_some_hundred_thousand():
    """Invented words are many: what was encoded once must not be forgotten soon."""
    texts = pa.array([" ".join(f"w{k:x}q" for k in range(a, a + 1000)) for a in range(0, 320_000, 1000)])
    bpe.encoder.cache_clear()
    ids, counts = bpe.encode(PATH, texts)
    bpe.encoder(PATH).tokenizer = None  # no call may follow
    again = bpe.encode(PATH, texts)
    bpe.encoder.cache_clear()
    assert again[0].tolist() == ids.tolist() and again[1].tolist() == counts.tolist()
    assert ids[: counts[0]].tolist() == reference(texts[0].as_py(), 1)[:-1]


def test_pieces_with_equal_hashes_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(bpe.Known, "hashed", lambda self, pieces: np.zeros(len(pieces), np.uint64))
    bpe.encoder.cache_clear()
    for text in ("one two six", "two ten", "six one", "ten two two"):
        assert bpe.encode(PATH, pa.array([text]))[0].tolist() == reference(text, 1)[:-1]
    bpe.encoder.cache_clear()


@pytest.mark.parametrize("lengths", [[7, 5, 5, 3, 3, 2, 1], [10, 10, 1], [], [4] * 9])
def test_best_fit_takes_the_tightest_window(lengths):
    got = packing.best_fit(lengths, 10)
    rooms, want = [], []
    for n in lengths:
        fits = [(r, -k) for k, r in enumerate(rooms) if r >= n]
        k = -min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(10)
        want.append(rooms[k])
        rooms[k] -= n
    assert [10 - o for o in got[1]] == want


def test_every_id_lies_in_one_piece(spark):
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (None, "null id")]
    got = packing.pack_documents(documents(spark, rows), PATH, window=64, bin_rows=50).toPandas()
    want = {}
    for i, t in rows:
        ids = reference(t, 1)
        for a in range(0, len(ids), 64):
            want.setdefault((-1 if i is None else i, a), []).append((len(ids[a : a + 64]), crc(ids[a : a + 64]), len(ids)))
    have = {}
    for r in got.fillna({"doc_id": -1}).itertuples():
        have.setdefault((r.doc_id, r.start), []).append((r.length, r.ids_crc32, r.doc_tokens))
    assert have == want
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert one["offset"].tolist() == [0, *one["length"].cumsum().tolist()[:-1]] and one["length"].sum() <= 64


def test_files_give_the_ids_back(spark):
    rows = list(enumerate(ODD))[::-1] + [(3, ODD[3]), (None, "null id")]
    folder = scratch_path(spark, "tokens-test")
    manifest = token_files.write_tokens(documents(spark, rows), PATH, folder, length=32, rows_per_file=5)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(manifest).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = reference(t, 0)
        want.append((i is None, i or 0, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    files = manifest.orderBy("part").collect()
    first = [x for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))[: files[0].docs] for x in reference(t, 0)]
    ids, mask = token_files.sequence(files[0].path + ".tokens.arrow", len(first) // 32)
    assert ids[mask].tolist() == first[len(first) // 32 * 32 :] and not ids.flags.owndata


def test_large_ids_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    (file,) = token_files.write_tokens(docs, PATH, f"file://{tmp_path}/wide", end_id=70_000, length=8).collect()
    with pa.ipc.open_file(next(tmp_path.glob("wide/**/*tokens*"))) as f:
        assert 70_000 in f.read_all().column("input_ids").combine_chunks().flatten().to_pylist()
    with pytest.raises(ValueError):
        token_files.write_tokens(docs, PATH, f"file://{tmp_path}/narrow", end_id=70_000, kind=pa.uint16())


def test_empty_tables(spark):
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0
    assert token_files.token_round_trip(documents(spark, []), PATH).count() == 0
