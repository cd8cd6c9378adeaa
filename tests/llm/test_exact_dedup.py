import hashlib
import random
import string

from pyspark.sql import functions as F

from driftmap.llm import exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows], SCHEMA)


def brute(rows):
    by = {}
    for i, t in rows:
        by.setdefault((t or "").translate(LOW), []).append(i)
    return sorted((i, max(by[x]), len(by[x]), i == max(by[x]), hashlib.sha256(x.encode()).hexdigest()) for i, t in rows for x in [(t or "").translate(LOW)])


def long_text(seed, n=30_000):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefgh iorn tdsÉÀ\n") for _ in range(n))


ROWS = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "É"), (6, "é"), (7, long_text(1)), (8, long_text(1).upper().replace("É", "É")), (9, long_text(1)), (10, long_text(2)), (11, "x" * 20_000), (12, "x" * 20_000), (13, "x" * 19_999)]


def test_groups_match_brute_force(spark):
    got = sorted(map(tuple, exact_dedup.exact_groups(documents(spark, ROWS)).collect()))
    assert got == brute(ROWS)


def test_digest_clashes_are_told_apart(spark):
    weak = lambda c: F.sha2(F.left(c, F.lit(1)), 256).cast("binary")  # noqa: E731  every chunk by its first letter
    got = sorted(map(tuple, exact_dedup.exact_groups(documents(spark, ROWS), weak).collect()))
    assert got == brute(ROWS)


def test_chunks_are_the_text(spark):
    df = documents(spark, ROWS).where("text IS NOT NULL").select("text", F.array_join(exact_dedup.chunks_of(F.col("text")), "").alias("again"))
    assert df.where("text <> again").count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "t"), (1, "t"), (None, "t"), (None, "u"), (None, "u"), (2, "v"), (2, "w")]
    got = exact_dedup.exact_groups(documents(spark, rows)).collect()
    assert sum(r.kept for r in got) == 4 and len(got) == 7
    kept = sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_exact_copies(documents(spark, rows)).collect())
    assert kept == [(0, "u"), (1, "t"), (2, "v"), (2, "w")]


def test_empty_table(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(documents(spark, [])).count() == 0
