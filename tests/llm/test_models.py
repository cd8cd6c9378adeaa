import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftmap.llm import language, lm_scoring, quality, words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_words_and_shingles_match_brute_force():
    rng = random.Random(1)
    texts = ["", None, " \n", "one", "A b  c\td", "x\x1cy z"] + ["".join(rng.choice(["a", "B", " ", "\n", "é", "\t", "😀"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    w = words.Words(pa.array(texts))
    split = [WORDS.findall(LOW(t)) for t in texts]
    assert w.counts.tolist() == [len(x) for x in split]
    flat = [x for s in split for x in s]
    key = words.new_key(5)
    hashes = w.hashes(key)
    for lane in hashes:
        assert len({(a, b) for a, b in zip(flat, lane.tolist())}) == len(set(flat)) == len(set(lane.tolist()))
    for n in (1, 3, 5):
        h, doc = words.shingles(w, n, key)
        for k, s in enumerate(split):
            want = {tuple(s[i : i + n]) for i in range(len(s) - n + 1)} if len(s) >= n else ({tuple(s)} if s else set())
            assert len(set(h[doc == k].tolist())) == len(want)


def test_siphash_vectors_and_long_words():
    key = np.frombuffer(bytes(range(16)), np.uint64)
    # The published vectors of 0, 7 and 15 bytes under the key 00 01 ... 0f.
    one = lambda n: np.frombuffer(bytes(range(n)) + bytes(7 - n % 8) + bytes([n]), "<u8").reshape(1, -1)
    assert [int(words.siphash(one(n), key)[0]) for n in (0, 7, 15)] == [0x726FDB47DD0E0E31, 0xAB0200F58B01D137, 0xA129CA6149BE45E5]
    values = pa.array([b"x" * n for n in range(1, 200)] + [b"x" * 99 + b"y", b"\0", b"\0\0"], pa.large_binary())
    found = words.keyed(values, words.new_key(2))
    assert len(np.unique(found)) == 2 * len(values)


def test_words_and_bigrams_made_up_to_collide_are_told_apart(spark):
    pairs = [("alpha beta gamma", "river rnh9fbm qzlbf23"), ("alpha beta", 'vlnuh1l "gm=8}1')]
    for a, b in pairs:
        w = words.Words(pa.array([a, b]))
        h, doc = words.shingles(w, 2, words.new_key(2))
        assert not set(h[doc == 0].tolist()) & set(h[doc == 1].tolist())
    docs = spark.createDataFrame([(1, pairs[1][0], True), (2, pairs[1][1], False)], "doc_id long, text string, target boolean")
    found = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(docs).collect()}
    # Four words, two for each side; neither model has seen the other's.
    floor = -(math.log(0.4 * 1 / 7) * 2) / 2
    seen = -(math.log(0.6 + 0.4 * 2 / 7) * 2) / 2
    assert abs(found[1].target_loss - seen) < 1e-9 and abs(found[1].background_loss - floor) < 1e-9 and abs(found[2].target_loss - floor) < 1e-9


def test_held_out_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 80)))
        good = rng.random() < 0.8
        rows.append((k, text if good else re.sub(" ", "### ", text).upper(), "clash"))
        labels += [(k, int(good))] if k % 2 else []
    rows += [(1000, None, ""), (1001, "", ""), (None, "some words", ""), (5, rows[5][1], "")]
    labels += [(5, None), (7, labels[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score_quality(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = dict(labels[:200])
    fold = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(fold) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in fold]) > 0.95
    none = quality.score_quality(docs, marks.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(docs.where("false"), marks).count() == 0


def test_cross_entropy_difference_by_hand(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 30))), k % 3 == 0) for k in range(60)]
    rows += [(100, None, True), (101, " ", None), (None, "A a B", False), (5, "zz zz", False)]
    got = lm_scoring.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string, target boolean"), vocabulary_size=6).collect()
    split = [(i, WORDS.findall(LOW(t)), bool(g)) for i, t, g in rows]
    every = Counter(w for _, s, _ in split for w in s)
    edge = sorted(every.values(), reverse=True)[6]
    known = [w for w in every if every[w] > edge]
    fold = lambda w: w if w in known else None
    models = []
    for side in (True, False):
        own = [[fold(w) for w in s] for _, s, g in split if g == side]
        models.append((Counter(w for s in own for w in s), Counter(p for s in own for p in zip([0, *s], s)), sum(1 for s in own if s)))

    def loss(s, model):
        one, two, starts = model
        total, size = 0.0, sum(one.values())
        for a, b in zip([0, *s], s):
            context = starts if a == 0 else one[a]
            p = 0.6 * min(1, two[a, b] / max(context, 1)) + 0.4 * (one[b] + 1) / (size + len(known) + 1)
            total -= math.log(p)
        return total / len(s)

    want = []
    for i, s, _ in split:
        s = [fold(w) for w in s]
        pair = [loss(s, m) for m in models] if s else [None, None]
        want.append((i is None, i or 0, len(s), *pair))
    have = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.target_loss, r.background_loss) for r in got), key=str)
    for a, b in zip(have, sorted(want, key=str)):
        assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None)
        assert a[3] is None or (a[3] == pytest.approx(b[3]) and a[4] == pytest.approx(b[4]))
    assert all((r.score is None) == (r.n_words == 0) for r in got)


def exact_losses(rows):
    """(target, background) loss of each of ``rows`` (text, target) by plain counts of all words and pairs."""
    split = [(WORDS.findall(LOW(t)), g) for t, g in rows]
    size, models = len({w for s, _ in split for w in s}) + 1, []
    for side in (True, False):
        own = [s for s, g in split if g == side]
        models.append((Counter(w for s in own for w in [0, *s]), Counter(p for s in own for p in zip([0, *s], s)), sum(map(len, own))))
    loss = lambda s, one, two, n: -sum(math.log(0.6 * two[a, b] / max(one[a], 1) + 0.4 * (one[b] + 1) / (n + size)) for a, b in zip([0, *s], s)) / len(s)
    return [tuple(loss(s, *m) for m in models) for s, _ in split]


def same_losses(spark, rows):
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, target boolean").repartition(3)
    got = sorted(lm_scoring.cross_entropy_difference(docs).collect())
    assert [r.doc_id for r in got] == list(range(len(rows)))
    for r, (target, background) in zip(got, exact_losses(rows)):
        assert r.target_loss == pytest.approx(target, rel=1e-9) and r.background_loss == pytest.approx(background, rel=1e-9)


def test_bigram_counts_are_exact(spark):
    rng = random.Random(11)
    many = [f"w{k}" for k in range(1500)]
    same_losses(spark, [(" ".join(rng.choice(many) for _ in range(80)), k % 2 == 0) for k in range(300)])


def test_every_word_is_in_the_vocabulary(spark):
    rare = [" ".join(f"{side}{k}" for k in range(35_000)) for side in "tb"]
    same_losses(spark, [(rare[0], True), (rare[1], False), ("t34000 t5 t34001", True), ("b34000 b5 b34001", False), ("t34000 b34000", False)])


def texts_of(letters, seed, n=60):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(4, 40))) for _ in range(n)]


def test_languages(spark):
    labelled = [(t, lang) for lang, letters in (("xx", "abcdé"), ("yy", "efghü"), (None, "ijk")) for t in texts_of(letters, 4)]
    languages, log = language.train_text_model(spark.createDataFrame(labelled, "text string, lang string"))
    assert languages == ["xx", "yy"]
    rows = [(k, t, "h", "xx") for k, t in enumerate(texts_of("abcdé", 5, 20))] + [(100 + k, t, "h", "clash") for k, t in enumerate(texts_of("efghü", 6, 20))]
    rows += [(200, None, "h", ""), (201, "12 !!", None, None), (202, "QZ" * 300 + "ЖЩ" * 300, None, None), (None, "abcdé abc", "h", None), (3, rows[3][1], "h", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, posterior string")
    got = language.identify(language.document_evidence(docs), languages, log).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[k].lang == "xx" for k in range(20)) and all(by[100 + k].lang == "yy" for k in range(20))
    assert [by[k].kept for k in (200, 201, 202)] == [False, False, False] and by[None].lang == "xx"
    kept = language.keep_known_languages(spark.createDataFrame([(i, t, s, "xx" if (i or 0) < 100 else "yy") for i, t, s, _ in rows], "doc_id long, text string, source string, lang string"))
    assert {r.doc_id for r in kept.collect()} >= {*range(20), *range(100, 120), None} and 200 not in {r.doc_id for r in kept.collect()}


def test_other_evidence_decides_short_texts(spark):
    labelled = [(t, lang) for lang, letters in (("xx", "abcd"), ("yy", "abce")) for t in texts_of(letters, 7)]
    languages, log = language.train_text_model(spark.createDataFrame(labelled, "text string, lang string"))
    page = lambda lang, body: f"<html lang='{lang}'><script>ddd</script><p>{body}</p></html>" if lang else f"<p>{body}</p>"
    rows = [(k, "http://a.example.xx/", page(None, t)) for k, t in enumerate(texts_of("abcd", 8, 30))]
    rows += [(50, "http://a.example.xx/b", page(None, "ab")), (51, "http://b.other.zz/", page("yy", "ab")), (52, None, None), (53, "http://a.example.xx/", page("qq", ""))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = {r.page_id: r for r in language.identify(language.page_evidence(pages), languages, log).collect()}
    assert by[50].lang == "xx" and by[51].lang == "yy" and by[52].lang == "und" and by[53].lang == "und"
    assert language.identify(language.page_evidence(pages.where("false")), languages, log).count() == 0


def plain_features(text):
    """The features of one text, byte by byte."""
    data = (text or "").encode()
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b in (32, 9, 10, 11, 12, 13) else 5 if b >= 128 else 0
    total = max(len(data), 1)
    shares = [math.sqrt(sum(min(b, 128) == k for b in data) / total) for k in range(129)]
    pairs = Counter(kind(b) * 6 + kind(a) for a, b in zip(data, data[1:]))
    shares += [math.sqrt(pairs[k] / total) for k in range(36)]
    split = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    n, lines = max(len(split), 1), data.count(b"\n")
    low = {re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in split}
    mean = sum(map(len, split)) / n
    part = lambda f: sum(map(f, split)) / n
    return shares + [min(mean / 10, 3), math.log1p(len(split)) / 10, len(low) / n, part(lambda w: kind(w[0]) == 1), part(lambda w: kind(w[-1]) == 0), part(lambda w: len(w) > 20), math.log1p(lines) / 10, lines / n]


def test_quality_by_hand():
    """Features byte by byte; weights by plain gradient ascent on the same pairs' likelihood; the threshold
    leaves as many training texts below it as were labelled bad."""
    rng = random.Random(8)
    texts = [None, "", " \n"] + ["".join(rng.choice("aB c.1é\n# ") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    got = quality.text_features(pa.array(texts))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-6)
    x = np.random.default_rng(1).normal(size=(40, 3)).astype(np.float32)
    good = x[:, 0] + 0.5 * x[:, 1] > 0.1
    model = quality.fit_ranking(x, good, pairs=10**6)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 0.01)
    # All pairs, each once or about once: the slope of the likelihood must vanish at the weights.
    order = np.random.default_rng(5)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    n = len(better) * len(worse)
    pick = lambda side: np.concatenate([order.permutation(side) for _ in range(-(-n // len(side)))])[:n]
    d = z[pick(better)] - z[pick(worse)]
    weights = np.zeros(3)
    for _ in range(20_000):
        weights += 2.0 * (d.T @ (1 / (1 + np.exp(d @ weights))) / n - quality.RIDGE * weights)
    assert np.allclose(model.weights, weights, atol=1e-3)
    assert (model.score(x) < 0.5).sum() == len(worse) and (model.score(x)[good] >= 0.5).mean() > 0.9


def test_languages_by_hand(spark):
    """The posterior of each document by plain sums over trigrams, hosts and all."""
    labelled = [(t, lang) for lang, letters in (("xx", "abcdé"), ("yy", "efghü")) for t in texts_of(letters, 4, 15)]
    languages, log = language.train_text_model(spark.createDataFrame(labelled, "text string, lang string"))
    rows = [(k, t, f"h{k % 3}") for k, t in enumerate(texts_of("abcdéefghü", 5, 20))] + [(50, "ab", None), (51, "éü ab", "h9")]
    got = language.identify(language.document_evidence(spark.createDataFrame(rows, "doc_id long, text string, source string")), languages, log).collect()

    def grams(text):
        fold = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
        return [fold[k : k + 3] for k in range(len(fold) - 2) if fold[k + 1] != 32]

    cell = lambda g: int(words.mix(np.array([g[0] << 16 | g[1] << 8 | g[2]], np.uint64))[0]) % 2**language.TRIGRAM_BITS
    size = 2**language.TRIGRAM_BITS
    counts = {lang: Counter(cell(g) for t, l in labelled if l == lang for g in grams(t)) for lang in languages}
    logs = lambda text: [language.TEMPER * sum(math.log((counts[lang][cell(g)] + 0.5) / (sum(counts[lang].values()) + 0.5 * size)) for g in grams(text)) for lang in languages] + [language.TEMPER * len(grams(text)) * -math.log(size)]
    soft = lambda v: [math.exp(a - max(v)) / sum(math.exp(b - max(v)) for b in v) for a in v]
    own = {i: soft(logs(t)) for i, t, _ in rows}
    hosts = {h: [sum(own[i][k] for i, t, s in rows if s == h and grams(t)) for k in range(3)] for h in {s for *_, s in rows if s}}
    every = [sum(v[k] for v in hosts.values()) for k in range(3)]
    root = [(e + 1) / (sum(every[:2]) + 2) * (1 - language.UNKNOWN) for e in every[:2]] + [language.UNKNOWN]
    for r in got:
        text, host = next((t, s) for i, t, s in rows if i == r.doc_id)
        prior = [(hosts[host][k] + language.SMOOTHING * root[k]) / (sum(hosts[host]) + language.SMOOTHING) for k in range(3)] if host else root
        want = soft([a + math.log(p) for a, p in zip(logs(text), prior)])
        assert r.posterior == pytest.approx(max(want), abs=1e-4)
        assert r.lang == ([*languages, "und"][want.index(max(want))] if grams(text) else "und")


def test_long_texts_ties_and_empty_tables(spark):
    long = "ab cd " * 100_000
    docs = spark.createDataFrame([(1, long, "s", True, 1), (2, long, "s", False, 2), (3, "", None, None, 3)], "doc_id long, text string, source string, target boolean, score int")
    scored = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(docs).collect()}
    assert scored[1].score == scored[2].score and scored[1].n_words == 200_000 and scored[3].score is None
    assert lm_scoring.cross_entropy_difference(docs.where("false")).count() == 0
    # Two languages with the same texts are alike to any text: the first by name wins.
    twins = spark.createDataFrame([("abc abd", lang) for lang in ("yy", "xx")], "text string, lang string")
    languages, log = language.train_text_model(twins)
    found = {r.doc_id: r.lang for r in language.identify(language.document_evidence(docs), languages, log).collect()}
    assert found == {1: "xx", 2: "xx", 3: "und"}
    assert language.identify(language.document_evidence(docs.where("false")), languages, log).count() == 0


def test_user_names_are_no_hosts(spark):
    pages = spark.createDataFrame([(1, "http://user:pw@Host.xx:80/a@b", None), (2, "http://host.yy/a@b", None)], "page_id long, url string, html string")
    assert {r.page_id: r.host for r in language.page_evidence(pages).collect()} == {1: "host.xx", 2: "host.yy"}


def test_page_evidence_by_hand(spark):
    """Text, declared language, suffix, host and domain of pages, fused by plain sums."""
    labelled = [(t, lang) for lang, letters in (("xx", "abcd"), ("yy", "efgh")) for t in texts_of(letters, 4, 15)]
    languages, log = language.train_text_model(spark.createDataFrame(labelled, "text string, lang string"))
    rng = random.Random(6)
    sites = ["a.one.xx", "b.one.xx", "one.yy", "c.two.yy", None]
    rows = []
    for k, t in enumerate(texts_of("abcdefgh", 7, 40)):
        site, said = rng.choice(sites), rng.choice([None, "xx", "YY", "zz"])
        html = f"<html{f' lang={said}' if said else ''}><script>hgfe hgfe</script><p>{t}</p></html>"
        rows.append((k, f"http://{site}/p" if site else None, html, "clash", 1.0, "x"))
    rows += [(90, "http://one.yy/", "<html lang='xx'></html>", "", 0.0, ""), (91, None, None, "", 0.0, ""), (None, "http://one.yy/", "<p>efgh efg</p>", "", 0.0, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, posterior double, text string")
    evidence = [r.asDict() for r in language.page_evidence(pages).collect()]
    assert all((e["domain"], e["suffix"]) == ((".".join(e["host"].split(".")[-2:]), e["host"].split(".")[-1]) if e["host"] else (None, None)) for e in evidence)

    def logs(text):
        fold = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
        found = [fold[k : k + 3] for k in range(len(fold) - 2) if fold[k + 1] != 32]
        cells = [int(words.mix(np.array([g[0] << 16 | g[1] << 8 | g[2]], np.uint64))[0]) % len(log) for g in found]
        return [language.TEMPER * sum(float(log[c, k]) for c in cells) for k in range(3)], len(found)

    soft = lambda v: [math.exp(a - max(v)) / sum(math.exp(b - max(v)) for b in v) for a in v]
    own = [(e, *logs(e["text"])) for e in evidence]
    add = lambda chosen: [sum(soft(v)[k] for _, v, _ in chosen) for k in range(3)]
    seen = [x for x in own if x[2]]
    every = add([x for x in seen if x[0]["host"]])
    root = [(e + 1) / (sum(every[:2]) + 2) * (1 - language.UNKNOWN) for e in every[:2]] + [language.UNKNOWN]
    smooth = lambda s, above: [(s[k] + language.SMOOTHING * above[k]) / (sum(s) + language.SMOOTHING) for k in range(3)]
    want = []
    for e, v, n in own:
        level = root
        if e["host"]:
            level = smooth(add([x for x in seen if x[0]["domain"] == e["domain"]]), root)
            level = smooth(add([x for x in seen if x[0]["host"] == e["host"]]), level)
        total = [a + math.log(p) for a, p in zip(v, level)]
        if e["suffix"]:
            of = add([x for x in seen if x[0]["suffix"] == e["suffix"]])
            total = [a + language.SUFFIX_WEIGHT * math.log((of[k] + 1) / (sum(of) + 3) / root[k]) for k, a in enumerate(total)]
        if e["declared"] in languages:
            total = [a + math.log(language.DECLARED if k == languages.index(e["declared"]) else (1 - language.DECLARED) / 2) for k, a in enumerate(total)]
        p = soft(total)
        named = [*languages, "und"][p.index(max(p))] if n or e["declared"] in languages else "und"
        want.append((str(e["page_id"]), named, round(max(p), 4)))
    got = language.identify(language.page_evidence(pages), languages, log).collect()
    assert sorted((str(r.page_id), r.lang, round(r.posterior, 4)) for r in got) == sorted(want)
    assert len({x[1] for x in want}) == 3


def test_very_many_languages(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}x " * 5, f"l{k:03d}", "s") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    languages, log = language.train_text_model(docs)
    assert len(languages) == 300 and log.shape == (2 ** language.cell_bits(300), 301) and log.nbytes <= language.MODEL_BYTES
    assert language.keep_known_languages(docs).count() > 0 and language.cell_bits(4) == language.TRIGRAM_BITS


def test_quality_of_long_texts_ties_and_repeated_labels(spark):
    long = "Good words here. " * 60_000
    rows = [(k, "fine words in a row " * (k % 5 + 1) if k % 2 else "### $$$ %%%" * (k % 5 + 1), 0.5) for k in range(60)] + [(100, long, 1.0), (101, long, 1.0), (2, "### again", 0.0), (2, "### again", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(2, 0)] * 50, "doc_id long, quality int")
    got = quality.score_quality(docs, marks).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (100, 101)}) == 1
    x, good = quality.labelled_features(docs.select("doc_id", "text"), marks, "quality", 1000)
    assert len(x) == 60 and good.sum() == 30  # a row an id, however often it occurs


def test_slices_of_the_models_merge_their_parts_in_little_memory():
    rng, parts, size, want = np.random.default_rng(3), [], 0, Counter()
    for _ in range(8):
        texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 50_000) for _ in range(200)]
        size += sum(map(len, texts))
        want.update(w for t in texts for w in t.split())
        rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(200), pa.int64()), "text": texts, "target": pa.array([k % 2 == 0 for k in range(200)])})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        parts.append(sink.getvalue().to_pybytes())
    parts, key = pa.array(parts, pa.binary()), words.new_key(2)
    tracemalloc.start()
    keys, counts = lm_scoring.slice_counts(parts, None, key)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9 * size  # it was 11.5 times the text when all parts were held with 64-bit counts
    assert (np.diff(keys[0].astype(object)) > 0).all() and len(keys[0]) == len(want) + 1
    assert sorted(counts[0].sum(axis=0)) == sorted([*want.values(), 1600])
    assert counts[1].sum() == sum(want.values())
    empty = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": pa.array([None], pa.string()), "target": [True]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, empty.schema) as out:
        out.write_batch(empty)
    keys, counts = lm_scoring.slice_counts(pa.array([sink.getvalue().to_pybytes()], pa.binary()), None, key)
    assert [len(k) for k in keys] == [0, 0] and [c.shape for c in counts] == [(2, 0), (2, 0)]
