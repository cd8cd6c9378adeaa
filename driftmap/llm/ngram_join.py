"""Jaccard join of word n-gram sets with prefix trees, and the components of its links.

Two texts link when their sets of distinct n-word shingles have a Jaccard similarity of at least
``num / den``.  The join is exact:

1. Sets that are equal (size and two 64-bit digests) link at once; the smallest doc_id stands for them.
   A count sketch of fixed size over all shingles gives each shingle a frequency level.  A shingle's
   token is (level, hash), so sorting tokens puts rare shingles first, in one order for all texts.
   The order only steers cost; any order gives the same links.
2. Sets that link have l common tokens among their first m - ceil(num / den * m) + l (m: a set's
   size, l: 1 + 3% of it).  Those prefixes are grouped by token into lists of documents.  Lists of up
   to ``PAIRED`` documents give pairs; pairs of too different sizes, or with too few common tokens,
   can't link and are dropped before any set moves.  Lists of up to ``COUNTED`` documents do so later,
   for documents that are in different components then.
3. What is left is compared in cells.  A cell's member sets form a prefix tree over their tokens; all
   probe sets walk it at once with their overlaps so far, a path shared by members is walked once, and
   a subtree is passed over where what is left of its longest set can't reach the overlap asked for
   (``trie_links``).
   First each document meets the smallest document it is paired with, and each large list's smallest
   document meets those of that list that it shares many lists with.  That takes rows in proportion to
   documents and lists and mostly joins groups of copies whole.  Pairs, and larger lists, that are then in
   several components are compared until no pair is left that could link; pairs that hang together as one
   cell or by blocks, where that takes fewer sets than the pairs one by one, and larger lists of mostly the
   same documents as one list.

Large groups of copies cost rows in proportion to their size, not to its square, as pairs that are
already in one component need no look.  Joins back from lists are salted.

A shingle is 58 bits of a hash under a secret key that each run draws anew (``words.shingles``): two
different shingles are taken for one with a probability of 2^-58, also where their texts were made up
to that end; for a pair of sets of a thousand shingles that is 3.5e-12.  The key doesn't leave the run,
and neither results nor reruns depend on it otherwise.

Defined cases: a null or empty text, or one of blanks only, has no shingles and no links; a text with
fewer than n words is one shingle; rows that share a doc_id are one document, whose links are those
of any of its rows; a null doc_id has no links and a null component; an empty table gives no rows; other
columns are ignored, or kept (``drop_near_copies``), whatever their names.  A text is a set in the
memory of one task, about twenty times its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.functions.joins import checked_broadcast, salted_join
from driftmap.llm import words
from driftmap.llm.components import components
from driftmap.llm.tables import summed_table
from driftmap.sources.scratch import made, materialize, numbered, without

SKETCH_BITS = 20
HASH_BITS = 58
#: Documents on either side of a cell.
BLOCK = 256
#: Lists up to this size give pairs of documents, whose common tokens are counted.
PAIRED = 64
#: Longer lists up to this size give pairs of documents of different components.  Unlike documents share ever longer
#: lists by chance as a corpus grows, and the sets of all their documents would be many times the texts.
COUNTED = 4096
#: Lists longer than that, and parts of them, up to this size are compared exhaustively in one cell.
SMALL = 256
#: Prefixes are longer by this share of a set, and linked sets have as many more tokens in common there.
ELL_PERCENT = 3
#: Rows of cells handled in one call.
CELL_ROWS = 500
#: Tokens of a path walked in one step.
STEP = 32


# ---- tokens


def frequency_levels(docs: DataFrame, n: int, key: np.ndarray) -> np.ndarray:
    """uint8 level (bits of the count) of each of 2^SKETCH_BITS buckets of shingles, over all rows."""
    size = 1 << SKETCH_BITS

    def count(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for texts in words.slices(batch.column("text")):
            found, _ = words.shingles(words.Words(texts), n, key)
            yield np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size)

    return np.minimum(np.ceil(np.log2(summed_table(docs.select("text"), size, count) + 1)), 31).astype(np.uint8)


def token_sets(texts: pa.Array, key: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles, of as many words as ``key`` has lanes, as sorted tokens."""
    found, doc = words.shingles(words.Words(texts), len(key), key)
    level = levels[(found & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    tokens = (level << np.uint64(HASH_BITS)) | (found & np.uint64((1 << HASH_BITS) - 1))
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(tokens[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def prefixes(docs: DataFrame, key: np.ndarray, num: int, den: int, levels) -> DataFrame:
    """doc_id, n_shingles, two digests of the whole set and its prefix tokens, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in words.slices(batch.column("text")):
                sets = token_sets(texts, key, levels.value)
                first = [s[: len(s) - -(-num * len(s) // den) + 1 + len(s) * ELL_PERCENT // 100] for s in sets]
                flat = np.concatenate(first).astype(np.int64) if first else np.zeros(0, np.int64)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in first]))).astype(np.int32)
                digests = [pa.array(np.array([words.mix(s ^ np.uint64(k)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for k in (1, 2)]
                columns = [batch.column("doc_id").slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), *digests, pa.ListArray.from_arrays(offsets, flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d1", "d2", "prefix"])
                at += len(texts)
        words.give_back()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, prefix array<long>")


# ---- cells


def trie_links(probes: list[np.ndarray], members: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(probe, member) index pairs of the sets whose Jaccard similarity is at least num / den.

    The members, sorted, are the prefix tree in depth-first order: the tokens a member shares with the
    one before it are a path already walked, whose overlaps with all probes are kept every STEP tokens.
    """
    order = sorted((k for k in range(len(members)) if len(members[k])), key=lambda k: members[k].astype(">u8").tobytes())
    some = [k for k in range(len(probes)) if len(probes[k])]
    if not order or not some:
        return []
    sizes = np.array([len(probes[k]) for k in some], np.int64)
    vocabulary = np.unique(np.concatenate([probes[k] for k in some]))
    inside = np.zeros((len(vocabulary) + 1, len(some)), np.uint8)  # the last row: tokens of no probe
    for column, k in enumerate(some):
        inside[np.searchsorted(vocabulary, probes[k]), column] = 1
    links, kept = [], [np.zeros(len(some), np.int64)]
    lengths = np.array([len(members[k]) for k in order], np.int64)
    shared = np.array([0, *(_common(members[a], members[b]) for a, b in zip(order, order[1:]))], np.int64)  # with the member before
    n = 0
    while n < len(order):
        own = members[order[n]]
        del kept[shared[n] // STEP + 1 :]  # overlaps of the path so far, after 0, STEP, 2 STEP ... tokens
        need = -(-num * (sizes + len(own)) // (num + den))
        fits = np.minimum(sizes, len(own)) >= need
        overlap, start = kept[-1], (len(kept) - 1) * STEP
        at = np.searchsorted(vocabulary, own[start:])
        at[at == len(vocabulary)] = 0
        at[vocabulary[at] != own[start:]] = len(vocabulary)
        depth, after = start, n + 1
        while depth < len(own):
            if not (fits & (overlap + (len(own) - depth) >= need)).any():
                # The members that share this path are next.  The longest of them can reach most above what is
                # asked of it; if even that can't, all of the subtree is passed over.
                end = after
                while end < len(order) and shared[end] >= depth:
                    end += 1
                longest = int(lengths[n:end].max())
                if not (overlap + (longest - depth) >= -(-num * (sizes + longest) // (num + den))).any():
                    after = end
                break
            overlap = overlap + inside[at[depth - start : depth - start + STEP]].sum(axis=0, dtype=np.int64)
            depth += STEP
            if depth <= len(own):
                kept.append(overlap)
        if depth >= len(own):
            links += [(some[p], order[n]) for p in np.flatnonzero(fits & (overlap >= need) & (den * overlap >= num * (sizes + len(own) - overlap)))]
        if after < len(order) and after > n + 1:
            shared[after] = shared[n + 1 : after + 1].min()  # the path that is left of the one walked last
        n = after
    return links


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    m = min(len(a), len(b))
    differs = np.flatnonzero(a[:m] != b[:m])
    return int(differs[0]) if len(differs) else m


def cell_links(cell: pa.Table, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links of one cell, as many as connect what is connected (a spanning forest)."""
    ids, roles = cell.column("doc_id").to_numpy(), cell.column("role").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in cell.column("tokens")]
    members = np.flatnonzero(roles & 2)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    probes = np.flatnonzero(roles & 1)
    while len(probes):  # as many at a time as keeps the incidence matrix under 64 MB
        tokens = np.cumsum([len(sets[k]) for k in probes])
        many = max(1, int((tokens * np.arange(1, len(probes) + 1) <= 64_000_000).sum()))
        own, probes = probes[:many], probes[many:]
        for p, m in trie_links([sets[k] for k in own], [sets[k] for k in members], num, den):
            a, b = int(ids[own[p]]), int(ids[members[m]])
            if root(a) != root(b):
                parent[root(a)] = root(b)
                yield a, b


def compare(docs: DataFrame, cells: DataFrame, key: np.ndarray, num: int, den: int, levels) -> DataFrame:
    """Links (a, b) found in ``cells`` (cell, doc_id, role: 1 probe, 2 member, 3 both).

    A cell's name is hashed to 62 bits and a role, so that a row of the join is two numbers; should two
    names meet in one number, their sets are compared with one another in vain.
    """
    cells = materialize(cells.select(F.col("doc_id").alias("_id"), F.expr("shiftleft(xxhash64(cell), 2) | role").alias("cell")), "cells")
    calls = max(1, -(-cells.count() // CELL_ROWS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in words.slices(batch.column("text")):
                own = batch.slice(at, len(texts))
                tokens = pa.array([s.tobytes() for s in token_sets(texts, key, levels.value)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("call"), own.column("cell"), own.column("doc_id"), own.column("role"), tokens], names=["call", "cell", "doc_id", "role", "tokens"])
                at += len(texts)
        words.give_back()

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("doc_id", "ascending")])
        names = table.column("cell").to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]))
        found = [x for a, b in zip(edges[:-1], edges[1:]) for x in cell_links(table.slice(a, b - a), num, den)]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    met = docs.join(checked_broadcast(cells), F.col("doc_id") == F.col("_id")).withColumn("role", F.expr("int(cell & 3)")).withColumn("cell", F.expr("cell - role"))
    rows = met.select(F.pmod(F.xxhash64("cell"), F.lit(calls)).alias("call"), "cell", "doc_id", "role", "text")
    shipped = rows.mapInArrow(sets, "call long, cell long, doc_id long, role int, tokens binary")
    return materialize(shipped.groupBy("call").applyInArrow(links, "a long, b long"), "links")


def star_cells(pairs: DataFrame) -> DataFrame:
    """Cells of a document (``center``) against those of ``pairs`` (center, doc_id), in blocks."""
    pairs = materialize(pairs.where("center <> doc_id").distinct(), "pairs")
    sizes = pairs.groupBy("center").agg(F.expr(f"(count(1) - 1) div {BLOCK} + 1").alias("blocks"))
    blocked = salted_join(pairs, sizes, ["center"], ["doc_id"]).select("center", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"))
    probes = sizes.select("center", F.col("center").alias("doc_id"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(1).alias("role"))
    cells = blocked.withColumn("role", F.lit(2)).unionByName(probes)
    return cells.select(F.format_string("s %d %d", "center", "block").alias("cell"), "doc_id", "role")


def pair_cells(pairs: DataFrame) -> DataFrame:
    """Cells that compare the documents of each of ``pairs`` (a, b).  Pairs that hang together are all pairs of
    their documents, in blocks, where that takes fewer rows than a cell for each of the smaller documents."""
    pairs = materialize(pairs.where("a <> b").distinct(), "pairs")
    groups = components(pairs)
    labelled = pairs.join(groups.select(F.col("id").alias("b"), F.col("component_id").alias("group")), "b")  # the larger of a pair has a row
    docs = groups.groupBy(F.col("component_id").alias("group")).agg((F.count(F.lit(1)) + 1).alias("docs"))
    facts = labelled.groupBy("group").agg(F.count(F.lit(1)).alias("pairs")).join(docs, "group")
    facts = materialize(facts.withColumn("blocks", F.expr(f"(docs - 1) div {BLOCK} + 1")).withColumn("dense", F.expr("docs * blocks <= 2 * pairs")), "pair-groups")
    apart = salted_join(labelled, facts.where("NOT dense").select("group"), ["group"], ["b"]).select(F.col("a").alias("center"), F.col("b").alias("doc_id"))
    dense = facts.where("dense").select("group", "blocks")
    members = groups.select(F.col("component_id").alias("group"), F.col("id").alias("doc_id")).unionByName(dense.select("group", F.col("group").alias("doc_id")))
    own = salted_join(members, dense, ["group"], ["doc_id"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    met = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    name = F.format_string("p %d %d %d", "group", F.least("own", "other"), F.greatest("own", "other"))
    role = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return star_cells(apart).unionByName(met.select(name.alias("cell"), "doc_id", role.alias("role")))


def _size_class(num: int, den: int):
    """Sizes of one class differ by less than what a link allows; a hair more, as logarithms round."""
    return F.expr(f"int(floor(ln(m) / {math.log(den / num) * (1 + 1e-9) if num < den else 1.0}))")


def list_cells(entries: DataFrame, lists: DataFrame, num: int, den: int) -> DataFrame:
    """Cells that compare all pairs of each list (token, n) that may be close enough in size: one cell if
    the list is small, else its documents by classes of size, in blocks, with those of their own class and the
    next one.  ``entries`` are (token, doc_id, m); a negative size is unknown and in every class."""
    sized = salted_join(entries, lists.select("token", "n"), ["token"], ["doc_id"])
    small = sized.where(f"n <= {SMALL}").select(F.format_string("t %d", "token").alias("cell"), "doc_id", F.lit(3).alias("role"))
    large = sized.where(f"n > {SMALL}").drop("n")
    known = large.where("m > 0").select("token", "doc_id", _size_class(num, den).alias("s"))
    blocks = materialize(known.groupBy("token", "s").agg(F.expr(f"int((count(1) - 1) div {BLOCK} + 1)").alias("blocks")), "size-classes")
    classes = blocks.groupBy("token").agg(F.collect_set("s").alias("all"))
    unknown = large.where("m <= 0").join(classes, "token", "left").select("token", "doc_id", F.explode(F.coalesce("all", F.array(F.lit(0)))).alias("s"))
    own = salted_join(known.unionByName(unknown), blocks, ["token", "s"], ["doc_id"], "left")
    placed = own.select("token", "doc_id", "s", F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("own"))
    near = placed.withColumn("s2", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)))
    others = blocks.select("token", F.col("s").alias("s2"), F.col("blocks").alias("many"))
    met = salted_join(near, others, ["token", "s2"], ["doc_id"], "left").where("many IS NOT NULL OR s = s2")
    met = met.select("token", "doc_id", "s", "own", "s2", F.explode(F.sequence(F.lit(0), F.coalesce("many", F.lit(1)) - 1)).alias("other"))
    # The smaller of two blocks probes.
    mine, other = F.struct("s", "own"), F.struct(F.col("s2").alias("s"), F.col("other").alias("own"))
    low, high = F.when(mine <= other, mine).otherwise(other), F.when(mine <= other, other).otherwise(mine)
    name = F.format_string("t %d %d %d %d %d", "token", low["s"], low["own"], high["s"], high["own"])
    return small.unionByName(met.select(name.alias("cell"), "doc_id", F.when(mine == other, 3).when(mine < other, 1).otherwise(2).alias("role")))


# ---- the join


def ell(m: str) -> str:
    """SQL for the number of common prefix tokens asked of sets of at least ``m`` shingles."""
    return f"(1 + {m} * {ELL_PERCENT} div 100)"


def close_sizes(a: str, b: str, num: int, den: int) -> str:
    """SQL: can sets of these sizes be similar enough?  A negative size is unknown."""
    return f"({a} < 0 OR {b} < 0 OR {den} * least({a}, {b}) >= {num} * greatest({a}, {b}))"


def candidate_pairs(lists: DataFrame, entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) with a < b of the documents that meet in lists of at most PAIRED documents, have close
    sizes and as many common prefix tokens as linked documents must have."""
    twos = lists.where("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b"), F.col("m_least").alias("ma"), F.col("m_most").alias("mb"))
    members = entries.where(f"n <= {PAIRED}").groupBy("token").agg(F.collect_list(F.struct("doc_id", "m")).alias("d"))
    close = f"filter(slice(d, i + 2, size(d)), y -> {close_sizes('x.m', 'y.m', num, den)})"  # others are never made
    met = members.select(F.explode(F.expr(f"flatten(transform(d, (x, i) -> transform({close}, y -> struct(least(x, y) AS x, greatest(x, y) AS y))))")).alias("p"))
    more = met.select(F.col("p.x.doc_id").alias("a"), F.col("p.y.doc_id").alias("b"), F.col("p.x.m").alias("ma"), F.col("p.y.m").alias("mb"))
    pairs = twos.unionByName(more).where(f"a < b AND {close_sizes('ma', 'mb', num, den)}").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.min("ma").alias("ma"), F.min("mb").alias("mb"))
    # Common tokens may also lie in larger lists: at most as many as ``a`` has there.
    large = checked_broadcast(entries.where(f"n > {PAIRED}").groupBy(F.col("doc_id").alias("a")).agg(F.count(F.lit(1)).alias("large")))
    enough = f"least(ma, mb) < 0 OR common + coalesce(large, 0) >= {ell('least(ma, mb)')}"
    return pairs.join(large, "a", "left").where(enough).select("a", "b")


def counted_pairs(labelled: DataFrame, lists: DataFrame, larger: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) with a < b of the documents of different components that meet in ``lists`` (token, same: lists
    equal to it, itself included), have close sizes and may have as many common prefix tokens as linked documents must have
    there and in lists that are longer still, of which ``larger`` (doc_id, n) counts a document's.

    Common tokens in shorter lists need no count: documents that have some have met there, and all of their
    longer lists counted for them (``candidate_pairs``)."""
    own = materialize(labelled.join(checked_broadcast(lists), "token"), "counted-entries")
    known = own.where("m > 0").withColumn("s", _size_class(num, den))
    side = lambda df, end, *keys: df.select("token", *keys, *[F.col(c).alias(f"{c}_{end}") for c in ("doc_id", "m", "component_id")])
    # The second of two documents is in the class of the first or in the next.
    second = known.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("next")).withColumn("s", F.col("s") - F.col("next"))
    met = side(known, "x", "s", "same").join(side(second, "y", "s", "next"), ["token", "s"]).where("next = 1 OR doc_id_x < doc_id_y").drop("s", "next")
    unknown = side(own.where("m <= 0"), "x", "same").join(side(own, "y"), "token")
    met = met.unionByName(unknown).where(f"doc_id_x <> doc_id_y AND component_id_x <> component_id_y AND {close_sizes('m_x', 'm_y', num, den)}")
    pairs = met.groupBy(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).agg(F.sum("same").alias("common"), F.min(F.least("m_x", "m_y")).alias("m"))
    more = checked_broadcast(larger.select(F.col("doc_id").alias("a"), F.col("n").alias("more")))
    return pairs.join(more, "a", "left").where(f"m < 0 OR common + coalesce(more, 0) >= {ell('m')}").select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document."""
    docs, key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words.new_key(n)
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, n, key))  # 2^SKETCH_BITS bytes
    sets = materialize(prefixes(docs, key, num, den, levels), "prefixes")
    usable = docs.where("doc_id IS NOT NULL")
    # Rows that share a doc_id may differ in size: theirs counts as unknown.
    repeated = sets.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_id")
    same = ["n_shingles", "d1", "d2"]
    whole_sets = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(whole_sets.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("first")).where("_n > 1").drop("_n"), "classes")
    few = checked_broadcast(classes)  # prefixes stay where they are
    classed = whole_sets.join(few, same, "left") if few is not classes else salted_join(whole_sets, classes, same, ["doc_id"], "left")
    equal = materialize(classed.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "equal")
    sized = classed.where("first IS NULL OR doc_id = first").join(checked_broadcast(repeated), F.col("doc_id") == F.col("_id"), "left")
    tokens = sized.select(F.explode("prefix").alias("token"), "doc_id", F.when(F.col("_id").isNull(), F.col("n_shingles")).otherwise(-1).alias("m"))
    grouped = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min_by("m", "doc_id").alias("m_least"), F.max_by("m", "doc_id").alias("m_most"))
    lists = materialize(grouped.where("least < most"), "lists")
    many = lists.where("n > 2").select("token", "n", "least", "m_least")
    few = checked_broadcast(many)
    entries = materialize(tokens.join(few, "token") if few is not many else salted_join(tokens, many, ["token"], ["doc_id"]), "entries")
    pairs = materialize(candidate_pairs(lists, entries, num, den), "candidates")
    large = entries.where(f"n > {PAIRED}")
    stars = pairs.groupBy("b").agg(F.min("a").alias("center")).select("center", F.col("b").alias("doc_id"))
    shared = large.where(close_sizes("m", "m_least", num, den)).groupBy(F.col("least").alias("center"), "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("m", "m_least")).alias("m"))
    # Copies share most lists with their smallest; what others have by chance is left to the pairs.
    stars = stars.unionByName(shared.where(f"m < 0 OR 2 * n >= {ell('m')}").select("center", "doc_id"))
    links = equal.unionByName(compare(usable, star_cells(stars), key, num, den, levels))
    for last in (False, True):
        whole = components(links)
        labels = whole.select(F.col("id").alias("doc_id"), "component_id")
        labelled = large.select("token", "doc_id", "m").join(labels, "doc_id", "left")
        labelled = materialize(labelled.select("token", "doc_id", "m", F.coalesce("component_id", "doc_id").alias("component_id")).distinct(), "labelled")
        open_lists = materialize(_open_lists(labelled), "open")
        if last:
            cells = list_cells(*_merged(labelled, open_lists), num, den)
        else:  # what pairs are not in one component yet; large lists get another centre
            larger = entries.where(f"n > {COUNTED}").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
            counted = counted_pairs(labelled, open_lists.where(f"n <= {COUNTED}").select("token", "same"), larger, num, den)
            centres = open_lists.where(f"n > {COUNTED}").select("token", F.col("other").alias("center"))
            in_stars = salted_join(labelled, centres, ["token"], ["doc_id"]).select("center", "doc_id")
            cells = star_cells(in_stars).unionByName(pair_cells(_apart(pairs, whole).unionByName(counted)))
            large = large.join(open_lists.where(f"n > {COUNTED}").select("token"), "token", "left_semi")
        cells = materialize(cells, "cells")
        if cells.isEmpty():
            break
        links = links.unionByName(compare(usable, cells, key, num, den, levels))
    else:
        whole = components(links)
    joined = sets.join(whole, F.col("doc_id") == F.col("id"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _apart(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ends are in different components."""
    label = lambda end: whole.select(F.col("id").alias(end), F.col("component_id").alias(f"c{end}"))
    found = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return found.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def _open_lists(labelled: DataFrame) -> DataFrame:
    """(token, n, other, same) of lists with documents of several components, of equal lists one; ``other``
    is a document outside the component with the smallest number, ``same`` how many are equal."""
    found = labelled.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("component_id").alias("low"),
        F.max("component_id").alias("high"),
        F.max_by("doc_id", "component_id").alias("other"),
        F.sum(F.expr("xxhash64(doc_id) >> 20")).alias("s1"),
        F.sum(F.expr("xxhash64(doc_id, 1) >> 20")).alias("s2"),
    )
    return found.where("low < high").groupBy("n", "s1", "s2").agg(F.min("token").alias("token"), F.max("other").alias("other"), F.count(F.lit(1)).alias("same")).select("token", "n", "other", "same")


def _merged(labelled: DataFrame, open_lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (token, doc_id, m) and lists (token, n), where lists of mostly the same documents are one.

    A passage that many documents share gives a list for each of its shingles.  Lists with the same
    least hash of a document (as probable as their overlap) become one if their union has at most
    twice the documents of the longest; comparing the union compares all that its lists would.
    """
    own = materialize(labelled.select("token", "doc_id", "m").distinct().join(checked_broadcast(open_lists.select("token", "n")), "token"), "open-entries")
    twins = own.groupBy("token", "n").agg(F.min(F.xxhash64("doc_id")).alias("twin"))
    entries = salted_join(own.drop("n"), twins, ["token"], ["doc_id"])
    longest = entries.groupBy("twin").agg(F.max("n").alias("longest"))
    unions = entries.select("twin", "doc_id", "m").distinct()
    sizes = unions.groupBy("twin").agg(F.count(F.lit(1)).alias("n"))
    merged = materialize(sizes.join(longest, "twin").where("n <= 2 * longest").select(F.col("twin").alias("token"), "n"), "merged")
    together = salted_join(unions.withColumnRenamed("twin", "token"), merged.select("token"), ["token"], ["doc_id"])
    alone = twins.join(merged.select(F.col("token").alias("twin")), "twin", "left_anti").select("token", "n")
    apart = salted_join(own.drop("n"), alone.select("token"), ["token"], ["doc_id"])
    return together.unionByName(apart), merged.unionByName(alone)


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each group of linked texts, the one with the smallest doc_id (null is the
    greatest).  Rows are judged by their own texts, also where they share a doc_id or have none."""
    rows, row = numbered(docs, "near-rows")
    since = made()
    found = materialize(jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), n, num, den).where("component_id < doc_id").select("component_id", F.col("doc_id").alias("_row")), "near")
    heads = found.select("component_id", F.col("component_id").alias("_row")).distinct()
    ids = rows.select(F.col(row).alias("_row"), F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("order"))
    members = materialize(ids.join(checked_broadcast(found.unionByName(heads)), "_row"), "near-members")
    first = members.groupBy("component_id").agg(F.min("order").alias("first"))
    gone = salted_join(members, first, ["component_id"], ["_row"]).where("order > first").select(F.col("_row").alias(row))
    return without(rows, row, gone, since)
