"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

from driftmap.llm import licences, mixing, prefix_trie

LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
s AS (SELECT DISTINCT doc_id, shingle FROM u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT x, x FROM e UNION SELECT e.y, r.other FROM r JOIN e ON r.doc_id = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    host = LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rows}),
p AS (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS nth
      FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE nth = 1
"""


def _scatter(x: str) -> str:
    p, q = mixing.PRIME, mixing.SECOND
    return f"(((({x}) % {p} * 1583458089 + 12345) % {q} * 784588716 + 6789) % {p} * 1132489760 + 987654321) % {q}"


def source_mixing(block: int = mixing.BLOCK, shard: int = mixing.SHARD, seed: int = 11, limit: int = 3) -> str:
    p, q, rounds = mixing.PRIME, mixing.SECOND, mixing.ROUNDS
    turns = ", ".join(f"(({_scatter(f'key + {3 * i}')}) * {p} + {_scatter(f'key + {3 * i + 1}')}) % blocks AS t{i}, {_scatter(f'key + {3 * i + 2}')} AS m{i}" for i in range(1, rounds + 1))
    steps = ""
    for i in range(1, rounds + 1):
        steps += f"""
a{i} AS (SELECT *, (t{i} - block + blocks) % blocks AS other FROM k{i - 1}),
k{i} AS (SELECT * EXCLUDE (block, other), CASE WHEN (((greatest(block, other) + m{i}) % {p}) * ((greatest(block, other) + m{i}) % {p}) % {q} * 784588716) % {p} % 2 = 1 THEN other ELSE block END AS block FROM a{i}),"""
    return f"""
WITH d0 AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
d AS (SELECT *, ({_scatter(f"abs(coalesce(doc_id, 0) % {p}) + ({_scatter('size')})")}) % (SELECT greatest({mixing.LEAST_BUCKETS}, count(*) // {mixing.BUCKET_ROWS}) FROM documents) AS bucket FROM d0),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS weight, source_size * {limit}.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS ratio FROM s2),
s4 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
s5 AS (SELECT *, least(cap, weight * max(CASE WHEN ratio >= level THEN level END) OVER ()) AS target,
         ceil(source_size / {block})::BIGINT AS blocks FROM s4),
s AS (SELECT *, CASE WHEN blocks > 0 THEN least(round(target * blocks / source_size)::BIGINT, {limit} * blocks) ELSE 0 END AS slots FROM s5),
n AS (SELECT greatest(1, (sum(slots) + {shard} - 1) // {shard})::BIGINT AS shards FROM s),
p0 AS (SELECT *, unnest(range(0, (slots - 1) // blocks + 1)) AS pass FROM s WHERE slots > 0),
p1 AS (SELECT sid, blocks, {_scatter(f"({_scatter(f'sid + {seed}')}) + pass")} AS key, least(blocks, slots - pass * blocks) AS n FROM p0),
p2 AS (SELECT sid, blocks, n, {_scatter("key")} AS draw, {turns} FROM p1),
k0 AS (SELECT *, pos AS block FROM (SELECT *, unnest(range(0, n)) AS pos FROM p2)),{steps}
x0 AS (SELECT sid, block, {_scatter("draw + pos")} AS x FROM k{rounds}),
u AS (SELECT sid, block, count(*) AS uses, min(({_scatter("x * x")}) % (SELECT shards FROM n)) AS shard FROM x0 GROUP BY ALL),
w AS (SELECT doc_id, size, sid, (sum(size) OVER (PARTITION BY sid ORDER BY bucket, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
x AS (SELECT doc_id, sid, size, start, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS block FROM w WHERE size > 0),
y AS (SELECT x.doc_id, sid, size, start, sum((least(start + size, (block + 1) * {block}) - greatest(start, block * {block})) * uses)::BIGINT AS taken, min(shard) AS first_shard
      FROM x JOIN u USING (sid, block) GROUP BY ALL)
SELECT w.doc_id, w.size, s.source_size, s.target, coalesce(y.taken, 0)::BIGINT AS taken, y.first_shard
FROM w JOIN s USING (sid) LEFT JOIN y ON y.sid = w.sid AND y.start = w.start AND y.size = w.size AND y.doc_id IS NOT DISTINCT FROM w.doc_id AND w.size > 0
"""


def licence_scan() -> str:
    words = [(k, i, w, i in t.must) for k, t in enumerate(licences.TEMPLATES) for i, w in enumerate(t.words)]
    names = [(k, t.label, t.base, len(t.words), len(t.must)) for k, t in enumerate(licences.TEMPLATES)]
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{licences.TOKEN}') AS words FROM documents),
t(t, label, base, n, must) AS (VALUES {", ".join(f"({k}, '{label}', {base}, {n}, {m})" for k, label, base, n, m in names)}),
p(t, pos, word, must) AS (VALUES {", ".join(f"({k}, {i}, '{w}', {m})" for k, i, w, m in words)}),
w AS (SELECT r, unnest(range(len(words))) AS place, unnest(words) AS word FROM d),
f AS (SELECT word, count(DISTINCT r) AS files FROM w GROUP BY word),
o AS (SELECT t, min(pos) AS pos, word FROM p GROUP BY t, word),
a AS (SELECT t, pos, word, row_number() OVER (PARTITION BY t ORDER BY coalesce(files, 0), pos) AS nth FROM o LEFT JOIN f USING (word)),
s AS (SELECT r, t, place - pos AS start FROM w JOIN a USING (word) WHERE nth <= 2 GROUP BY r, t, place - pos HAVING count(*) = 2),
c AS (SELECT s.r, s.t, s.start, count(w.word) AS stands, count(*) FILTER (w.word IS NOT NULL AND p.must) AS must
      FROM s JOIN p USING (t) LEFT JOIN w ON w.r = s.r AND w.place = s.start + p.pos AND w.word = p.word GROUP BY ALL),
m AS (SELECT r, label, base, start, stands / n AS share, c.must = t.must AND stands / n >= {licences.LEAST_SHARE} AS match FROM c JOIN t USING (t)),
g AS (SELECT r, count(*) FILTER (match AND base) AS n_base, min(start) FILTER (match AND base) AS first_word, max(start) FILTER (match AND base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (match AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (match) AS labels, max(share) AS score FROM m GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""


def source_divergence(least_docs: int = 30, add: int = 5, scale: int = 1_000_000_000, top: int = 50) -> str:
    price = lambda n, total: f"(1 + ({scale}::HUGEINT * ({n} + {add})) // ({total} + {add} * V))::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= {least_docs}),
l AS (SELECT lang, count(*) AS V, sum(total) AS whole FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS whole FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, {price("coalesce(n, 0)", "coalesce(s.whole, 0)")} AS p, {price("total", "l.whole")} AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT g.lang, g.source, h.source AS item FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM x LEFT JOIN f USING (lang, source, item)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""


def prefix_tree() -> str:
    # CRC-32 of an id, bit by bit (a fixed value: its reversed polynomial).
    bits = "flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda k: [ascii(substr(c::VARCHAR, k, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
    digest = "sha256(octet_length(encode(role)) || ':' || role || text)"
    return f"""
WITH t0 AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, octet_length(encode(text)) AS bytes, {digest} AS turn_id, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, {digest}) AS pos FROM t0),
n AS (SELECT c, count(*) AS n, c - c % {prefix_trie.FAMILY} AS head, {crc} % {prefix_trie.HEADS} AS h FROM t0 GROUP BY c),
v AS (SELECT n.c, n.head, n.h, least(n.h, coalesce(m.n, 0)) AS shift FROM n LEFT JOIN n m ON m.c = n.head),
r AS (SELECT v.c, pos AS d, bytes, turn_id FROM v JOIN t ON t.c = v.head AND pos <= h UNION ALL SELECT v.c, shift + pos - h, bytes, turn_id FROM v JOIN t ON t.c = v.c AND pos > h),
k AS (SELECT c, d, bytes, string_agg(turn_id, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS key FROM r UNION ALL SELECT c, 0, 0, '' FROM v),
z AS (SELECT c, max(d) AS depth FROM k GROUP BY c),
u AS MATERIALIZED (SELECT d, key, any_value(bytes) AS bytes, count(*) AS n, min(k.c) AS conv_id,
       sha256(coalesce(string_agg(k.c::VARCHAR, ',' ORDER BY k.c) FILTER (d = depth), '')) AS ends_sha256 FROM k JOIN z USING (c) GROUP BY d, key),
e AS (SELECT *, CASE WHEN d > 0 THEN left(key, length(key) - 64) END AS up FROM u),
w AS (SELECT up AS key, count(*) AS n_children FROM e WHERE d > 0 GROUP BY up),
b AS (SELECT e.key, e.n, e.bytes, coalesce(w.n_children, 0) AS n_children FROM e LEFT JOIN w USING (key)),
s AS (SELECT e.key, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.bytes)::BIGINT AS saved_tokens FROM e JOIN b ON starts_with(b.key, e.key) GROUP BY e.key)
SELECT e.conv_id, e.d::BIGINT AS depth, p.conv_id AS parent_conv_id, e.n AS n_convs, b.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256
FROM e JOIN b USING (key) JOIN s USING (key) LEFT JOIN u p ON p.key = e.up
"""
