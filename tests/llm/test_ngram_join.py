import random
import re

import numpy as np

from driftmap.llm import ngram_join
from driftmap.llm.components import components

SCHEMA = "doc_id long, text string, component_id string, token long"


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and den * len(x & y) >= num * len(x | y):
                a_, b_ = root(i), root(j)
                parent[max(a_, b_)] = min(a_, b_)
    return sorted(((i is None, i or 0, len(x), None if i is None else root(i)) for i, x in sets), key=str)


def corpus(seed, count, vocabulary=60, group=0.5):
    rng = random.Random(seed)
    texts = []
    for _ in range(count):
        if texts and rng.random() < group:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + rng.randint(0, 1)] = [f"w{rng.randrange(vocabulary)}"]
            texts.append(rng.choice([" ", "\n", "\t "]).join(w))
        else:
            texts.append(" ".join(f"W{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, 120))))
    return texts


def rows_of(found):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in found.collect()), key=str)


def test_matches_brute_force(spark):
    texts = corpus(1, 150) + [None, "", " \n", "one", "ONE", "one two", "é é é É", "x " * 5000, "x " * 4999 + "y"]
    rows = [(7 * k % 1009, t) for k, t in enumerate(texts)] + [(None, "one")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    assert rows_of(ngram_join.jaccard_components(df, 3, 90, 100)) == brute(rows, 3, 90, 100)


def test_blocks_of_large_lists(spark, monkeypatch):
    """With tiny blocks every path is taken: stars in blocks, a second centre, blocks by blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "PAIRED", 2)
    rows = list(enumerate(corpus(2, 120, vocabulary=6, group=0.8)))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    assert rows_of(ngram_join.jaccard_components(df, 2, 7, 10)) == brute(rows, 2, 7, 10)


def test_pairs_of_longer_lists_are_counted(spark, monkeypatch):
    """Lists beyond COUNTED by blocks, others by pairs; pairs that hang together in several blocks."""
    for counted in (5, 4096):
        for name, value in (("BLOCK", 4), ("SMALL", 3), ("PAIRED", 2), ("COUNTED", counted)):
            monkeypatch.setattr(ngram_join, name, value)
        rows = list(enumerate(corpus(3, 120, vocabulary=6, group=0.8))) + [(7, "w1 w2 w3 w4"), (7, "w3 w1")]
        df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
        found = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(df, 2, 7, 10).collect()}
        assert found == {(i, c) for _, i, _, c in brute(rows, 2, 7, 10)}


def test_sets_of_unlike_documents_with_common_shingles_stay(spark, monkeypatch):
    """Each document is in several lists by chance; its set isn't sent for each of them."""
    rng, sent, compare = random.Random(6), [], ngram_join.compare

    def counting(docs, cells, *rest):
        sent.append(cells.count())
        return compare(docs, cells, *rest)

    monkeypatch.setattr(ngram_join, "compare", counting)
    monkeypatch.setattr(ngram_join, "PAIRED", 4)
    rows = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(190, 210)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.jaccard_components(df, 2, 9, 10)) == brute(rows, 2, 9, 10)
    assert sum(sent) <= 2 * len(rows)


def test_trie_matches_all_pairs():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 90, rng.integers(0, 120)).astype(np.uint64)) for _ in range(40)]
    sets = base + [np.unique(np.append(s[rng.random(len(s)) > 0.08], rng.integers(0, 90, 2).astype(np.uint64))) for s in base]
    got = sorted((int(p), int(m)) for p, m in ngram_join.trie_links(sets[:50], sets, 8, 10))
    want = [(p, m) for p in range(50) for m in range(80) if len(sets[p]) and len(sets[m]) and 10 * len(np.intersect1d(sets[p], sets[m])) >= 8 * len(np.union1d(sets[p], sets[m]))]
    assert got == want


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    hub = [(5, k) for k in range(200, 260)] + [(300, 250), (301, 300), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + hub, "a long, b long")).collect()))
    assert got == {k: 100 for k in range(101, 141)} | {k: 5 for k in [*range(200, 260), 300, 301]}


def test_empty_table(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlapping_lists_become_one_and_others_stay(spark):
    lists = {t: range(100) for t in (1, 2)} | {3: range(1, 99), 4: range(500, 600), 5: [*range(700, 800), 0]}
    rows = [(t, d, 10, d) for t, docs in lists.items() for d in docs]
    labelled = spark.createDataFrame(rows, "token long, doc_id long, m long, component_id long")
    sizes = spark.createDataFrame([(t, len(d)) for t, d in lists.items()], "token long, n long")
    entries, merged = ngram_join._merged(labelled, sizes)
    found = {}
    for r in entries.collect():
        found.setdefault(r.token, []).append(r.doc_id)
    assert {r.token: r.n for r in merged.collect()} == {t: len(d) for t, d in found.items()}
    assert all(len(set(d)) == len(d) for d in found.values())
    for docs in lists.values():
        assert any(set(docs) <= set(d) for d in found.values())
    assert len(found) <= 4


def test_twins_of_polynomial_hashes_stay_apart(spark):
    text = ["a"]
    for _ in range(12):
        text.append(text[-1] + text[-1].translate(str.maketrans("ab", "ba")))
    rows = [(2 * n + k, t) for n in (10, 11, 12) for k, t in enumerate((text[n], text[n].translate(str.maketrans("ab", "ba"))))]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted(tuple(r) for r in got) == [(i, 1, i) for i, _ in rows]


def test_texts_made_up_to_collide_stay_apart(spark):
    rows = [(1, "alpha beta gamma"), (2, "river rnh9fbm qzlbf23"), (3, "Alpha beta  gamma")]
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert rows_of(found) == [(False, 1, 1, 1), (False, 2, 1, 2), (False, 3, 1, 1)]
