import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_stages_on_a_small_corpus(spark):
    rng = random.Random(1)
    base = [" ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(80)) for _ in range(30)]
    rows = [(k, t, "xx", f"s{k % 3}", 0, "e") for k, t in enumerate(base)]
    rows += [(100, base[4].upper(), "xx", "s1", 0, "e"), (101, base[5] + " one more", "xx", "s2", 0, "e"), (102, None, None, None, None, None), (103, "12 34", "xx", "s0", 0, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        kept.append((name, {r.doc_id for r in docs.collect()}))
        if name != "packing":
            assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    found = dict(kept)
    every = {*range(30), 100, 101}
    assert found["language_id"] == every
    assert found["exact_dedup"] == every - {4}
    assert found["ngram_jaccard"] == every - {4, 101}
    assert found["source_mixing"] <= found["ngram_jaccard"] and found["packing"] == found["source_mixing"]


CLASH = ["_gone", "_id", "_again", "row", "_row", "times", "a.b", "component_id", "order"]


def awkward(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"{k} AS `{c}`" for k, c in enumerate(CLASH)))


def test_rows_with_shared_and_missing_ids(spark):
    """Every row is judged by its own text, and columns keep their names and values."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(60))
    one, two, three = text(), text(), text()
    rows = [(9, one, "xx", "s", 0), (9, "12 34", "xx", "s", 1), (None, "56", None, "s", 2), (None, two, "xx", "s", 3), (5, two, "xx", "s", 4), (7, three, "xx", None, 5), (7, three + " more", "xx", "s", 6), (None, three + " too", "xx", "s", 7)]
    docs = awkward(spark, rows + [(100 + k, text(), "xx", "s", 100 + k) for k in range(20)])
    kept = lambda df: {r.n_chars for r in df.collect() if r.n_chars < 100}
    after = corpus_pipeline.keep_languages(spark, docs, "")
    assert kept(after) == {0, 3, 4, 5, 6, 7} and after.columns == docs.columns
    after = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept(after) == {0, 1, 2, 4, 5, 6, 7} and after.columns == docs.columns
    after = corpus_pipeline.drop_near_copies(spark, docs, "")
    found = kept(after)
    assert found in ({0, 1, 2, 4, 5}, {0, 1, 2, 4, 6}) and after.columns == docs.columns
    assert all(r[c] == k for r in after.collect() for k, c in enumerate(CLASH))


def test_run_by_hand(spark, tmp_path):
    """``run`` over a written table: what is packed are the ids of the rows that brute force keeps."""
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(80))
    base = [text() for _ in range(40)]
    rows = [(k, t, "xx", f"s{k % 2}", 0) for k, t in enumerate(base)]
    rows += [(100, base[3].upper(), "xx", "s0", 0), (101, base[6] + " one more", "xx", "s0", 0), (102, None, None, None, None), (103, "12 34", "xx", "s0", 0), (104, base[7], "xx", "s1", 0), (104, base[7], "xx", "s1", 0)]
    awkward(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, t, s) for i, t, _, s, _ in rows if i not in (3, 7, 101, 102, 103)][:-1]
    size = {s: sum(len(t.split()) for _, t, x in kept if x == s) for s in ("s0", "s1")}
    total = sum(size.values())
    share = {"s0": total / 3, "s1": 2 * total / 3}  # weights 1 and 2; neither reaches 3 times its size
    assert share["s1"] < 3 * size["s1"]
    plain = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in kept}
    assert {r.doc_id for r in got} <= set(ids)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for s in share:
        words = sum(len(t.split()) for r in got if r.start == 0 for i, t, x in kept if i == r.doc_id and x == s)
        assert abs(words - share[s]) < 0.25 * share[s]


def test_run_on_an_empty_table(spark, tmp_path):
    awkward(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_lists_all_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
