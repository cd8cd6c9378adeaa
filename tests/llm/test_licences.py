import random
import re

from driftmap.llm import licences
from driftmap.llm.licences import Template

TOKEN = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, templates):
    split = [(i, words_of(t)) for i, t in rows]
    frequency = {}
    for _, w in split:
        for x in set(w):
            frequency[x] = frequency.get(x, 0) + 1
    out = []
    for i, w in split:
        base, labels, score = [], set(), 0.0
        for t in templates:
            n = len(t.words)
            rare = licences.rare_positions(t, frequency)
            for s in range(-n, len(w)):
                at = lambda k: w[s + k] if 0 <= s + k < len(w) else None  # noqa: B023, E731
                if all(at(k) == t.words[k] for k in rare):
                    share = sum(at(k) == t.words[k] for k in range(n)) / n
                    score = max(score, share)
                    if share >= 0.8 and all(at(k) == t.words[k] for k in t.must):
                        labels.add(t.label)
                        base += [(s, t.label)] if t.base else []
        starts = [s for s, _ in base]
        out.append((i, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scanned(spark, rows, templates=licences.TEMPLATES):
    df = spark.createDataFrame([(i, t, "clash", 0.5, "x") for i, t in rows], "doc_id long, text string, words string, score double, found string")
    return sorted((tuple(r[c] for c in COLUMNS) for r in licences.scan_licences(df, templates).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = sorted({w for t in licences.TEMPLATES for w in t.words}) + ["é", "x1", "CC", "By"]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(0, 12)):
            t = rng.choice(licences.TEMPLATES).words
            k = rng.randrange(len(t))
            parts.append(rng.choice([" ".join(t), " ".join(t[k:]), "-".join(t[:k] + [rng.choice(vocabulary)] + t[k + 1 :]).upper(), " ".join(rng.choices(vocabulary, k=3))]))
        texts.append(rng.choice([" ", "\n", ". "]).join(parts))
    texts += [None, "", " .-", "cc", "cc by cc by", "CC BY-NC 4.0", "all all rights reserved rights reserved", "ccé by", "cc_by", "Kcc by", "cc by " * 3000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "all rights reserved"), (3, texts[3])]
    assert scanned(spark, rows) == brute(rows, licences.TEMPLATES)


def test_edited_templates_and_missing_keys(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [(0, notice), (1, notice.replace("obtaining", "getting")), (2, notice.replace("hereby ", "")), (3, notice.replace("granted", "given")), (4, "hereby obtaining")]
    found = {r[0]: r for r in scanned(spark, rows)}
    assert found[0][6] == "mit" and found[0][7] == 1.0
    assert found[3][6] == "" and found[4][6] == ""
    assert scanned(spark, rows) == brute(rows, licences.TEMPLATES)


def test_own_templates_ties_and_empty_table(spark):
    twice = [Template("t", "a b a b"), Template("u", "b b"), Template("v", "a b c d e f g h i j", ("a b",))]
    rows = [(0, "a b a b a b"), (1, "b b b"), (2, "a b c d x f g h i j"), (3, "x b c d e f g h i j"), (4, "e")]
    assert scanned(spark, rows, twice) == brute(rows, twice)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan_licences(empty).count() == 0
