import random
import re

from pyspark.sql import functions as F

from driftmap.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least_docs, add, scale, top):
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(t for t in {x for d in own for x in d[2]} if sum(t in d[2] for d in own) >= least_docs)
        V = len(kept)

        def prices(chosen):
            n = {t: 0 for t in kept}
            for d in chosen:
                for t in d[2]:
                    if t in n:
                        n[t] += 1
            N = sum(n.values())
            return {t: (1 + scale * (n[t] + add) // (N + add * V), n[t]) for t in kept}

        q = prices(own)
        sources = sorted({d[1] for d in own})
        p = {s: prices([d for d in own if d[1] == s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t][0] - p[o][t][0]) for t in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted((q[t][0] - p[s][t][0], t.encode()) for t in kept if p[s][t][1] and p[s][t][0] > q[t][0])
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms[:top])]
    return sorted(out)


def audited(spark, rows, **options):
    df = spark.createDataFrame([(k % 7, *r, 1, "y") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, value int, item string")
    found = divergence.source_divergence(df, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def some_rows(seed, n, vocabulary=40, sources=6):
    rng = random.Random(seed)
    terms = [f"{a}{b}" for a in ["a", "B", "é", "zz", "日"] for b in "abcdefgh"][:vocabulary]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "fr", None, ""])
        source = rng.choice([None, "", "hot", "hot", *map(str, range(sources))])
        rows.append((rng.choice([" ", "1", "_"]).join(rng.choice(terms[: rng.randint(1, len(terms))]) for _ in range(rng.randint(0, 25))), lang, source))
    return rows + [(None, "de", None), ("", "de", "x"), ("lone terms", "xx", "s"), ("many " * 4000, "en", "hot")]


def test_matches_brute_force(spark, monkeypatch):
    rows = some_rows(1, 150)
    assert audited(spark, rows, least_docs=5) == brute(rows, 5, 5, 10**9, 50)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "CELL_ROWS", 20)
    monkeypatch.setattr(divergence, "HELD_ROWS", 30)
    assert audited(spark, rows, least_docs=2, top=3) == brute(rows, 2, 5, 10**9, 3)


def test_radix_top_with_many_ties(spark):
    rng = random.Random(3)
    rows = []
    for g in ("a", "b", None, "one"):
        items = {"".join(rng.choice("aé日b") for _ in range(rng.randint(0, 6))) for _ in range(60)} | {"x" * n for n in range(1, 9)}
        rows += [(g or "", x, rng.choice([0, 1, 1, 5, 2**30 - 1]) if g != "one" else 7) for x in sorted(items)]
    rows += [("small", "t", 3), ("small", "", 3)]
    df = spark.createDataFrame(rows, "g string, item string, value long").repartition(5)
    for k in (1, 7, 40, 1000):
        got = sorted((r.g, r["rank"], r.item, r.value) for r in divergence.radix_top(df, ["g"], "value", "item", k, few=4).collect())
        want = []
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]
            want += [(g, n + 1, r[1], r[2]) for n, r in enumerate(own)]
        assert got == sorted(want), k


def test_prices_beyond_64_bits_and_empty_table(spark):
    row = spark.range(1).select(divergence.price(F.lit(10**15).cast("long"), F.lit(4 * 10**15).cast("long"), F.lit(3).cast("long"), 5, 10**9).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 5) // (4 * 10**15 + 15)
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(empty).count() == 0
    assert audited(spark, [("a b", "en", "s"), ("c", "en", "t")]) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
