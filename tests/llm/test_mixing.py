import random
import re

from driftmap.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, sid string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], SCHEMA)


def corpus(seed, count=300):
    rng = random.Random(seed)
    return [(k, " \n".join("w" * 2 for _ in range(rng.choice([0, 1, 5, 50, 300]))), rng.choice(["a", "a", "a", "B", "ä", "z", None])) for k in range(count)]


def targets(sizes, cycle=(1, 2, 3), limit=3):
    """Shares by weight, sources over their limit set to it and the rest shared again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: limit * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows = corpus(1) + [(5, None, "a"), (None, "x y", "tiny"), (None, "x y", "tiny")]
    got = mixing.mix_documents(documents(spark, rows), block=16, shard=64).collect()
    sizes, words = {}, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets(sizes)
    assert len(got) == len(rows) and sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, words(t)) for i, t, _ in rows)
    by_size = {sizes[s]: s for s in sizes}
    taken = {}
    for r in got:
        s = by_size[r.source_size]
        assert abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16 * 2
    again = mixing.mix_documents(documents(spark, rows), block=16, shard=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


P, Q = 2147483647, 2147483629


def scatter(x):
    return (((x % P * 1583458089 + 12345) % Q * 784588716 + 6789) % P * 1132489760 + 987654321) % Q


def slots_by_hand(sid, blocks, slots, seed, shards, rounds=8):
    """(shard, block) of each slot of a source: the draw of its shard, and swap-or-not rounds, one by one."""
    out = []
    for k in range(slots):
        turn, at = divmod(k, blocks)
        key = scatter(scatter(sid + seed) + turn)
        b = at
        for i in range(1, rounds + 1):
            t, m = (scatter(key + 3 * i) * P + scatter(key + 3 * i + 1)) % blocks, scatter(key + 3 * i + 2)
            mirror = (t - b) % blocks
            if (((max(b, mirror) + m) % P) ** 2 % Q * 784588716) % P % 2:
                b = mirror
        out.append((scatter(scatter(scatter(key) + at) ** 2) % shards, b))
    return out


def test_slots_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TASK_SLOTS", 500)
    facts = [(1, 1, 3), (2, 2, 5), (3, 700, 1650), (4, 5000, 4999), (5, 0, 0)]
    sources = spark.createDataFrame(facts, "sid int, blocks long, slots long")
    got = mixing.mix_slots(sources, 11, 64)
    assert got.rdd.getNumPartitions() > 8  # no task makes all slots of a source
    got = got.collect()
    shards = -(-sum(n for _, _, n in facts) // 64)
    want = sorted((shard, sid, block) for sid, blocks, n in facts for shard, block in slots_by_hand(sid, blocks, n, 11, shards))
    assert sorted((r.shard, r.sid, r.block) for r in got) == want
    uses = {}
    for _, sid, block in want:
        uses[sid, block] = uses.get((sid, block), 0) + 1
    # Each pass is a permutation: uses differ by one at most.
    assert all({uses.get((sid, b), 0) for b in range(blocks)} <= {n // blocks, n // blocks + 1} for sid, blocks, n in facts if blocks)
    assert [b for _, b in slots_by_hand(4, 5000, 4999, 11, 1)] != list(range(4999))


def test_draws_are_multinomial():
    """Counts of a source's slots by shard: chi-square of a fair draw, and other shards another count."""
    n, shards = 20_000, 100
    counts = [0] * shards
    for shard, _ in slots_by_hand(7, 30_000, n, 11, shards):
        counts[shard] += 1
    chi = sum((c - n / shards) ** 2 / (n / shards) for c in counts)
    assert 55 < chi < 160 and len(set(counts)) > 10


def test_repeated_documents_and_empty_tables(spark):
    rows = corpus(2)
    docs = documents(spark, rows)
    mixed = mixing.repeat_to_mix(docs)
    assert mixed.columns == docs.columns
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in mixing.mix_documents(docs).collect():
        assert times.get(r.doc_id, 0) in (r.taken // max(1, r.size), -(-r.taken // max(1, r.size)))
    assert all((r.first_shard is None) == (r.taken == 0) for r in mixing.mix_documents(docs).collect())
    assert mixing.mix_documents(documents(spark, [])).count() == 0 and mixing.repeat_to_mix(documents(spark, [])).count() == 0
    assert mixing.mix_documents(documents(spark, [(1, "", "a"), (2, None, None)])).where("taken = 0 AND target = 0").count() == 2


def test_rows_that_share_an_id_are_taken_each_by_itself(spark):
    rows = [(1, "a b c d", "s", "x"), (1, "", "s", "y"), (None, "e f g", "s", "z"), (None, None, None, "n"), (2, "w " * 200_000, "t", "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string").selectExpr("*", "1 AS _again", "2 AS row", "3 AS times", "4 AS `a.b`", "5 AS _copies")
    got = mixing.repeat_to_mix(docs, cycle=(1, 1))
    assert got.columns == docs.columns
    found = [r["_id"] for r in got.collect()]
    assert "y" not in found and "n" not in found and {"x", "z"} <= set(found) and all(r["_again"] == 1 and r["a.b"] == 4 for r in got.collect())


def test_crowded_buckets_are_split(spark, monkeypatch):
    """Rows without doc_id and of one size share a bucket: its parts stay small, and words are numbered without gaps."""
    monkeypatch.setattr(mixing, "CROWDED", 100)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    facts = [(k, None, 1, 4, 7) for k in range(2000)] + [(5000 + k, k, 1, 1 + k % 3, k % 5) for k in range(60)] + [(9000, None, 2, 0, 7), (9001, None, 2, 9, 7)]
    named = spark.createDataFrame(facts, "_row long, doc_id long, sid int, size long, bucket long")
    got = mixing.word_starts(named).collect()
    assert len(got) == len(facts)
    parts = {}
    for r in got:
        parts[r.sid, r.bucket, r.part] = parts.get((r.sid, r.bucket, r.part), 0) + 1
    assert max(parts.values()) < 100 and len(parts) > 30
    for sid in (1, 2):
        spans = sorted((r.start, r.start + r.size) for r in got if r.sid == sid and r["size"])
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_rows_without_ids_draw_their_own_repeats(spark):
    """All documents alike and without doc_id: some come once, some twice, and the words come near the target."""
    docs = spark.createDataFrame([(None, "w " * 10, "a", k) for k in range(3000)] + [(None, "w " * 10, "b", k) for k in range(3000, 5000)], "doc_id long, text string, source string, n int")
    got = mixing.repeat_to_mix(docs, cycle=(1, 2), block=7)
    times = {(r.source, r.n): r["count"] for r in got.groupBy("source", "n").count().collect()}
    words = {s: sum(10 * n for (x, _), n in times.items() if x == s) for s in "ab"}
    want = targets({"a": 30_000, "b": 20_000}, (1, 2))
    for s in "ab":
        assert abs(words[s] - want[s]) < 0.06 * want[s]
    assert len({times.get(("b", k), 0) for k in range(3000, 5000)}) > 1
