import hashlib
import random
import zlib

from driftmap.llm import prefix_trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(head, [])[:h] + v[h:])
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        childless = [q for q in under if not any(len(x) > len(q) and x[: len(q)] == q for x in under)]
        ends = sorted(c for c in members if len(built[c]) == len(p))
        out.append(
            (
                min(members),
                len(p),
                min(nodes[p[:-1]]) if p else None,
                len(members),
                sum(len(q) == len(p) + 1 for q in under),
                len(childless),
                sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def built(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, d int, key string").repartition(3)
    return sorted((tuple(r[n] for n in NAMES) for r in prefix_trie.prefix_trie(df).collect()), key=str)


def some_rows(seed, many, longest, texts=("a", "b", "é", "", None)):
    rng = random.Random(seed)
    rows = []
    for _ in range(many):
        c = rng.choice([rng.randint(-12, 60), rng.randint(0, 9)])
        for k in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows + [(None, 0, "user", "a"), (70, 0, "user", "a"), (70, 0, "user", "a")]


def test_matches_brute_force(spark, monkeypatch):
    rows = some_rows(1, 60, 6, ("a", "a", "b"))
    assert built(spark, rows) == brute(rows)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    monkeypatch.setattr(prefix_trie, "SEGMENT", 2)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = some_rows(2, 60, 15)
    # Copies of one conversation, and long ones that part late.
    for c in range(100, 140):
        rows += [(c, k, "user", "same") for k in range(9, 13)]
    for c in (200, 201, 202, 203):
        rows += [(c, k, "user", f"{k}" if k < 20 + c % 5 else f"{c}") for k in range(40)]
    assert built(spark, rows) == brute(rows)


def test_single_turns_and_empty_table(spark):
    rows = [(3, 0, "user", "x"), (5, 0, "user", "x"), (6, 1, "user", "y"), (6, 0, None, None)]
    assert built(spark, rows) == brute(rows)
    assert built(spark, [(None, 0, "user", "x")]) == []
