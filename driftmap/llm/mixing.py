"""Mixing sources to target weights over fixed-length blocks.

Each source's words, documents one behind another, are cut into blocks of ``block`` words.  Its target
fixes how many blocks the mix takes of it, each a slot of an output shard.  A source's slots are dealt to
the shards by a multinomial draw: every slot takes a shard uniformly at random, so the counts of a
source over all shards are multinomial, and those of a shard have the targets' shares as means, while
each source's total stays within half a block of its target.  The k-th slot of a source takes block
perm(k), a pseudorandom permutation of its block numbers, anew for each pass over the source.  Slots
and blocks meet in one join by (source, block).

The permutation is a swap-or-not shuffle, a bijection for any number of blocks, written as plain
column arithmetic; so are the random numbers, which depend on the seed and the position alone, so
reruns agree.  All steps are DataFrame functions.  The slots are made chunk by chunk in as many tasks
as they need, a large source is spread by its blocks, and the running totals that number its words
go over hash buckets of documents, so it never meets in a task.  A bucket crowded by rows that share
their doc_id (or have none) and their size is split by row.

Defined cases: a null text has no words; a null source is a source, the last in order; sources
without words get target 0; repeated rows, also with equal or null doc_id, are separate documents; an
empty table gives an empty mix; other columns are ignored (``mix_documents``) or kept (``repeat_to_mix``).
A text of any length is one row of counts and a row for each of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.functions.joins import checked_broadcast
from driftmap.llm.text import WORD
from driftmap.sources.scratch import free_name, made, materialize, numbered, release, with_marks

BLOCK = 64
#: Slots of a shard, on average.
SHARD = 4096
ROUNDS = 8
#: Slots made from one row, and in one task.
CHUNK, TASK_SLOTS = 4096, 100_000
#: Documents of a bucket of running totals, if there are more than LEAST_BUCKETS such.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 1024
#: Rows of a source in one bucket beyond which the bucket is split by row.
CROWDED = 100_000
PRIME = 2147483647
SECOND = 2147483629


def scattered(x: str) -> str:
    """SQL for a number in [0, SECOND) that looks random, from a non-negative one: three linear steps
    modulo two primes in turn.  ``x`` occurs once, so nested calls stay small expressions."""
    return f"(((({x}) % {PRIME}L * 1583458089L + 12345L) % {SECOND}L * 784588716L + 6789L) % {PRIME}L * 1132489760L + 987654321L) % {SECOND}L"


def water_level(sources: DataFrame, limit: int) -> DataFrame:
    """``sources`` (sid, weight, source_size) with ``target``: all sizes shared by weight, at most
    ``limit`` times a source's own size, what is cut off shared again among the others."""
    cap = F.col("source_size") * F.lit(float(limit))
    every = Window.partitionBy()
    filled = Window.orderBy("_ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_ratio", "sid").rowsBetween(0, Window.unboundedFollowing)
    ranked = sources.withColumn("_cap", cap).withColumn("_ratio", cap / F.col("weight"))
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("_cap").over(filled), F.lit(0.0))
    levels = ranked.withColumn("_level", left / F.sum("weight").over(rest))
    level = F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(every)
    return levels.withColumn("target", F.least("_cap", level * F.col("weight"))).drop("_cap", "_ratio", "_level")


def source_table(sized: DataFrame, cycle: tuple[int, ...], limit: int, block: int) -> DataFrame:
    """One row a source: sid, source, weight, source_size, target, blocks, slots."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source: this window and those of the water level see sources, never documents.
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("sid") - 1) % len(cycle) + 1).cast("double")
    table = water_level(totals.withColumn("sid", sid).withColumn("weight", weight), limit)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * limit)
    return table.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("blocks") > 0, slots).otherwise(0))


def slot_chunks(sources: DataFrame, seed: int, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """(sid, blocks, low, high, draw, t1, m1, t2 ...): the slots low to high (exclusive) of a pass over a
    source, with the numbers that the draw of shards and each round of the pass's permutation take."""
    passes = sources.where("slots > 0").selectExpr("sid", "blocks", "slots", "explode(sequence(0L, (slots - 1) div blocks)) AS pass")
    sized = passes.selectExpr("sid", "blocks", f"{scattered(f'{scattered(f"sid + {seed}")} + pass')} AS key", "least(blocks, slots - pass * blocks) AS n")
    turn = lambda i: f"({scattered(f'key + {3 * i}')} * {PRIME}L + {scattered(f'key + {3 * i + 1}')}) % blocks AS t{i}"
    numbers = [x for i in range(1, rounds + 1) for x in (turn(i), f"{scattered(f'key + {3 * i + 2}')} AS m{i}")]
    cut = sized.selectExpr("sid", "blocks", "n", f"{scattered('key')} AS draw", *numbers, f"explode(sequence(0L, (n - 1) div {chunk})) AS c")
    rest = [f"{x}{i}" for i in range(1, rounds + 1) for x in "tm"]
    return cut.selectExpr("sid", "blocks", f"c * {chunk} AS low", f"least(n, (c + 1) * {chunk}) AS high", "draw", *rest)


def permuted(slots: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``slots`` (``at``, blocks, t1, m1 ...) with ``block``: a bijection of 0 ... blocks - 1 applied to
    ``at``.  A round swaps the block with its mirror image round the turn, or not, for both alike."""
    out = slots.withColumn("block", F.col("at"))
    for i in range(1, rounds + 1):
        out = out.withColumn("_other", F.expr(f"(t{i} - block + blocks) % blocks"))
        out = out.withColumn("_x", F.expr(f"(greatest(block, _other) + m{i}) % {PRIME}L"))
        bit = f"(_x * _x % {SECOND}L * 784588716L) % {PRIME}L % 2"
        out = out.withColumn("block", F.expr(f"CASE WHEN {bit} = 1 THEN _other ELSE block END"))
    return out.drop("_other", "_x")


def mix_slots(sources: DataFrame, seed: int = 11, shard: int = SHARD) -> DataFrame:
    """(shard, sid, block), a row for each slot of the mix: what each output shard takes of each source."""
    total = sources.agg(F.sum("slots")).first()[0] or 0  # one number
    shards, tasks = max(1, -(-total // shard)), max(1, min(20_000, total // TASK_SLOTS))
    spread = slot_chunks(sources, seed).repartition(tasks, "sid", "low", "draw")
    slots = spread.withColumn("at", F.explode(F.expr("sequence(low, high - 1)")))
    # Squares, as linear steps alone would deal neighbouring slots too evenly.
    drawn = permuted(slots).selectExpr("sid", "block", f"{scattered('draw + at')} AS x")
    return drawn.selectExpr(f"{scattered('x * x')} % {shards} AS shard", "sid", "block")


def word_starts(named: DataFrame) -> DataFrame:
    """``named`` (_row, doc_id, sid, size, bucket) with ``part`` and ``start``: the words of the documents
    of its source before it, in the order of buckets, parts, doc_id, size and row."""
    counts = named.groupBy("sid", "bucket").agg(F.count(F.lit(1)).alias("_rows")).where(f"_rows > {CROWDED}")
    crowded = materialize(counts.select("sid", "bucket", F.expr(f"_rows div {BUCKET_ROWS} + 1").alias("_parts")), "crowded")
    dealt = named.join(checked_broadcast(crowded), ["sid", "bucket"], "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("_row"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    place = ["bucket", "part"]
    totals = dealt.groupBy("sid", *place).agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("sid").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("sid", *place, F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("sid", *place).orderBy(F.col("doc_id").asc_nulls_last(), "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["sid", *place])
    return placed.withColumn("start", F.col("_base") + F.col("_inside")).drop("_base", "_inside")


def mixed_rows(docs: DataFrame, row: Column, cycle: tuple[int, ...], limit: int, block: int, shard: int, seed: int) -> DataFrame:
    """_row, doc_id, sid, start, size, source_size, target, taken, first_shard: one row a document."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("size")), "sizes")
    buckets = max(LEAST_BUCKETS, sized.count() // BUCKET_ROWS)
    sources = materialize(source_table(sized, cycle, limit, block), "sources")
    ids = sources.select("sid", F.col("source").alias("_source"))
    bucket = F.expr(f"{scattered(f'abs(coalesce(doc_id, 0) % {PRIME}) + {scattered("size")}')} % {buckets}")
    named = sized.join(checked_broadcast(ids), F.col("source").eqNullSafe(F.col("_source"))).select("_row", "doc_id", "sid", "size", bucket.alias("bucket"))
    placed = word_starts(named)
    spans = F.when(F.col("size") > 0, F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))
    pieces = placed.select("_row", "doc_id", "sid", "size", "start", F.explode_outer(spans).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    uses = materialize(mix_slots(sources, seed, shard).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"), F.min("shard").alias("shard")), "uses")
    used = pieces.join(uses, ["sid", "block"], "left")
    taken = used.groupBy("_row", "doc_id", "sid", "start", "size").agg(F.coalesce(F.sum(overlap * F.col("uses")), F.lit(0)).alias("taken"), F.min("shard").alias("first_shard"))
    facts = checked_broadcast(sources.select("sid", "source_size", "target"))
    return taken.join(facts, "sid").select("_row", "doc_id", "sid", "start", "size", "source_size", "target", "taken", "first_shard")


def mix_documents(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), limit: int = 3, block: int = BLOCK, shard: int = SHARD, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken (the words the mix takes) and first_shard (the first
    shard that takes any of them, else null), one row a document.

    Sources in code point order, null last, weigh ``cycle`` repeating; targets share all words by
    weight, but stop at ``limit`` times a source's size.
    """
    return mixed_rows(docs, F.monotonically_increasing_id(), cycle, limit, block, shard, seed).drop("_row", "sid", "start")


def repeat_to_mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), limit: int = 3, block: int = BLOCK, shard: int = SHARD, seed: int = 11) -> DataFrame:
    """``docs`` with each row as often as the mix takes its words: the whole part of taken / size,
    and once more with the rest as probability, drawn for each row.  Rows without words go; rows that share a doc_id, or
    have none, are taken each by itself.  All columns stay as they are."""
    rows, row = numbered(docs, "mix-rows")
    since, times = made(), free_name(rows, "times")
    mix = mixed_rows(rows, F.col(row), cycle, limit, block, shard, seed).where("taken > 0")
    # A row's random number is that of its first word's place: rows that share a doc_id draw each its own.
    x = scattered(f"{scattered(f'sid + {seed}')} + start")
    mix = mix.withColumn("_x", F.expr(x))
    extra = F.expr(f"int({scattered('_x * _x')} / {PRIME}D < (taken % size) / size)")
    many = mix.select(F.col("_row").alias(row), (F.expr("taken div size") + extra).cast("int").alias(times)).where(F.col(times) > 0)
    marked = with_marks(rows, row, many, times, limit)
    release(since, -1)
    again = F.explode(F.array_repeat(F.lit(0), F.col(times)))
    return marked.where(F.col(times) > 0).withColumn(times, again).drop(row, times)
