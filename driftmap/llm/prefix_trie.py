"""The prefix trie of conversations, built as a Patricia tree.

Every conversation is rebuilt (``rebuilt_turns``), and a node is a sequence of first turns (role, text).
Texts are read once: a turn goes on as its SHA-256 and its number of bytes.

1. *Prefix keys.*  The key of a conversation's first d turns is the sum, in four lanes of 32 bits, of hashes of
   (d, turn) under a secret that each run draws anew, so two different prefixes share a key with a
   probability of 2^-128.  A sum can be run in pieces: a conversation of any length is numbered in range
   partitions and added up in runs of ``RUN`` turns.
2. *Sort.*  Conversations with equal turns are one sequence, for the smallest.  Sequences are cut into
   segments of ``SEGMENT`` prefix keys, each with the key before it, and sorted as arrays; where a segment
   parts from its neighbour there is a branch.  So only branch, end and leaf points (and the root) are made.
3. *Compressed tree.*  Turns at points give each point its members; the point before on a member's path
   ends the compressed edge above.  A point's smallest member owns it.  Leaves and saved tokens of
   a subtree are sums over the members of what they own below, so no level waits for another.
4. *Expansion.*  The nodes inside an edge have one child and the members of the point below; their saved
   tokens are the point's and a suffix sum over the edge, a difference of two running sums of the owner.

Members' ids that end at a point are joined in blocks of ``IDS`` by as many tasks as there are blocks; a
stream over the blocks of a point, which holds one at a time, makes the SHA-256.

Defined cases: null role or text is empty; rows with a null conv_id belong to no conversation and are left
out; turns with equal (or null) numbers are ordered by the SHA-256 of role and text; repeated rows are turns
each; a table without conversations gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmap.functions.joins import checked_broadcast, salted_join
from driftmap.operators.indexing import dense_index
from driftmap.sources.scratch import materialize

#: Turns summed up in one window, keys in a segment that is sorted, and ids in a block that is joined.
RUN, SEGMENT, IDS = 256, 64, 4096
#: A conversation takes up to so many turns, less one, from the first of each ``FAMILY``.
HEADS, FAMILY = 9, 5
LANES = [f"k{n}" for n in range(4)]
NOTHING = hashlib.sha256(b"").hexdigest()


def by_key(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (unique in ``on``), which is broadcast where it is small; else salted."""
    few = checked_broadcast(right)
    return left.join(few, on, how) if few is not right else salted_join(left, right, on, spread, how)


# ---- conversations


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, turn, digest, bytes; the digest is that of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth) of every rebuilt conversation, and its turns (conv, depth, d, digest, bytes), d = 1, 2 ...

    A conversation c takes the first crc32(c) % HEADS turns of conversation c - c % FAMILY in the place of
    its own.
    """
    placed = dense_index(turns_of(conversations), ["conv", F.col("turn").asc_nulls_first(), "digest"], "place")
    own = placed.groupBy("conv").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    own = materialize(own.select("*", (F.col("conv") - F.col("conv") % FAMILY).alias("head"), (F.crc32(F.col("conv").cast("string")) % HEADS).alias("h")), "conversations")
    lent = own.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    shift = F.least("h", F.coalesce("head_n", F.lit(0)))
    convs = own.join(lent, "head", "left").select("conv", "first", "head", "h", shift.alias("shift"), (shift + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))
    convs = materialize(convs, "rebuilt-conversations")
    numbered = by_key(placed, convs, ["conv"], ["place"]).withColumn("pos", F.col("place") - F.col("first") + 1)
    numbered = materialize(numbered.select("conv", "h", "shift", "depth", "pos", "digest", "bytes"), "turns")
    heads = numbered.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv").alias("head"), F.col("pos").alias("d"), "digest", "bytes")
    taken = convs.select("conv", "depth", "head", "h").join(heads, "head").where("d <= h")  # 9 conversations of 8 turns for a key
    kept = numbered.where("pos > h").withColumn("d", F.col("shift") + F.col("pos") - F.col("h"))
    names = ["conv", "depth", "d", "digest", "bytes"]
    return convs.select("conv", "depth"), kept.select(names).unionByName(taken.select(names))


def with_prefix_keys(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, depth, d, digest, bytes) with the ``key`` of the first d turns and their bytes, ``total``."""
    mark = F.sha2(F.concat(F.lit(secrets.token_hex(32)), F.col("d").cast("string"), F.lit(":"), F.col("digest")).cast("binary"), 256)
    lanes = [F.conv(F.substring(mark, 8 * k + 1, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(LANES)]
    marked = materialize(turns.select("conv", "depth", "d", "bytes", F.expr(f"(d - 1) div {RUN}").alias("run"), *lanes), "marked-turns")
    sums = [*LANES, "bytes"]
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.where(f"depth > {RUN}").groupBy("conv", "run").agg(*[F.sum(c).alias(c) for c in sums])
    bases = totals.select("conv", "run", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in sums])
    inside = Window.partitionBy("conv", "run").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    added = marked.select("conv", "depth", "d", "bytes", "run", *[F.sum(c).over(inside).alias(f"sum_{c}") for c in sums])
    met = by_key(added, materialize(bases, "runs"), ["conv", "run"], ["d"], "left")
    total = lambda c: F.col(f"sum_{c}") + F.coalesce(f"base_{c}", F.lit(0))
    key = F.concat(*[F.lpad(F.hex(total(c) % (1 << 32)), 8, "0") for c in LANES])
    return met.select("conv", "depth", "d", "bytes", total("bytes").alias("total"), key.alias("key"))


# ---- the compressed tree


def member_hashes(ends: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of ``ends`` (rep, conv): the SHA-256 of the ids of each rep, ascending, with commas."""
    placed = materialize(dense_index(ends, ["rep", "conv"], "place"), "members")
    first = placed.groupBy("rep").agg(F.min("place").alias("first"))
    blocks = by_key(placed, first, ["rep"], ["place"]).select("rep", "conv", F.expr(f"(place - first) div {IDS}").alias("block"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    joined = blocks.groupBy("rep", "block").agg(ids.alias("ids"))  # IDS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, digest, done = None, None, []
        for batch in batches:
            for own, text in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
                if own != rep:
                    done += [(rep, digest.hexdigest())] if digest else []
                    rep, digest = own, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["rep", "ends_sha256"])
                done = []
        done += [(rep, digest.hexdigest())] if digest else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["rep", "ends_sha256"])

    return joined.repartition("rep").sortWithinPartitions("rep", "block").select("rep", "ids").mapInArrow(run, "rep long, ends_sha256 string")


def branch_points(rows: DataFrame) -> DataFrame:
    """(d, key) where neighbours among the sorted sequences of ``rows`` (conv, depth, d, key) part."""
    own = F.expr(f"(d - 1) div {SEGMENT}")
    # A segment begins with the key before it.
    both = F.when((F.col("d") % SEGMENT == 0) & (F.col("d") < F.col("depth")), F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.select("conv", "d", "key", F.explode(both).alias("s"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("d", "key"))), lambda x: x["key"])
    cut = dealt.groupBy("conv", "s").agg(keys.alias("keys"))  # SEGMENT + 1 keys at most
    cut = cut.select("s", F.when(F.col("s") == 0, F.concat(F.array(F.lit("")), "keys")).otherwise(F.col("keys")).alias("keys")).distinct()
    placed = materialize(dense_index(cut, ["s", "keys"], "place"), "segments")
    following = placed.select((F.col("place") - 1).alias("place"), F.col("s").alias("s2"), F.col("keys").alias("keys2"))
    met = placed.join(following, "place").where("s = s2 AND keys[0] = keys2[0]")
    shared = F.size(F.array_intersect("keys", "keys2"))  # a key stands for all before it
    return met.withColumn("_shared", shared).select((F.col("s") * SEGMENT + F.col("_shared") - 1).alias("d"), F.element_at("keys", F.col("_shared")).alias("key")).distinct()


POINT = ["d", "key"]


def compressed_tree(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """One row a point: d, key, owner, n, the point above (up_d, up_owner), the bytes of its path (total) and of
    that above, n_children, n_leaves, ``below`` (tokens saved strictly below) and the rep that ends here.

    ``rows`` (conv, depth, d, key, bytes, total) are the turns of the ``reps`` (conv, depth, key, many).
    """
    ends = reps.select(F.col("depth").alias("d"), "key")
    root = reps.select(F.lit(0).cast("long").alias("d"), F.lit("").alias("key")).limit(1)
    points = materialize(branch_points(rows).unionByName(ends).unionByName(root).distinct(), "points")
    # Members of points: turns of sequences at points, and every sequence at the root.
    met = by_key(rows.select("conv", *POINT, "total"), points, POINT, ["conv"])
    zero = F.lit(0).cast("long")
    met = met.unionByName(reps.select("conv", zero.alias("d"), F.lit("").alias("key"), zero.alias("total")))
    met = by_key(met, reps.select("conv", "depth", "many"), ["conv"], ["d"])
    path = Window.partitionBy("conv").orderBy("d")  # points on one path
    lag = lambda c: F.lag(c).over(path).alias(f"up_{c}")
    members = materialize(met.select("conv", "depth", "many", *POINT, "total", lag("d"), lag("key"), lag("total")), "members")
    end = F.col("depth") == F.col("d")
    facts = members.groupBy(*POINT).agg(
        F.sum("many").alias("n"),
        F.min("conv").alias("owner"),
        *[F.max(c).alias(c) for c in ("total", "up_d", "up_key", "up_total")],
        F.max(F.when(end, F.col("conv"))).alias("end_rep"),
    )
    facts = materialize(facts, "point-facts")
    up = ["up_d", "up_key"]
    children = facts.where("up_d IS NOT NULL").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children")).select(F.col("up_d").alias("d"), F.col("up_key").alias("key"), "n_children")
    above = facts.select(F.col("d").alias("up_d"), F.col("key").alias("up_key"), F.col("owner").alias("up_owner"))
    facts = by_key(facts.join(children, POINT, "left"), above, up, ["key"], "left")
    facts = materialize(facts.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "point-edges")
    # What a sequence owns: the edges above its points, and the leaf at its end.
    edge = (F.col("n") - 1) * (F.col("total") - F.col("up_total"))
    owned = facts.select(*POINT, "owner", edge.alias("edge"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    known = by_key(members.select("conv", *POINT, "depth"), owned, POINT, ["conv"])
    deeper = Window.partitionBy("conv").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv")
    mine = F.when(F.col("owner") == F.col("conv"), F.col("edge"))
    known = known.select(*POINT, F.coalesce(F.sum(mine).over(deeper), F.lit(0)).alias("below"), F.max(F.when(end, F.col("leaf"))).over(every).alias("leaf"))
    sums = known.groupBy(*POINT).agg(F.sum("below").alias("below"), F.sum("leaf").alias("n_leaves"))
    return facts.join(sums, POINT)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node."""
    convs, turns = rebuilt_turns(conversations)
    rows = materialize(with_prefix_keys(turns), "prefixes")
    ends = rows.where("d = depth").select("conv", "depth", "key").unionByName(convs.where("depth = 0").withColumn("key", F.lit("")))
    ends = materialize(ends, "ends")
    reps = materialize(ends.groupBy("depth", "key").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("many")), "sequences")
    equal = reps.where("many > 1").select("depth", "key", F.col("conv").alias("rep"))
    hashes = member_hashes(by_key(ends, equal, ["depth", "key"], ["conv"]).select("rep", "conv"))
    hashes = hashes.unionByName(reps.where("many = 1").select(F.col("conv").alias("rep"), F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends_sha256")))
    sole = materialize(by_key(rows, reps.select("conv"), ["conv"], ["d"]), "sole-prefixes")
    tree = compressed_tree(sole, reps).join(hashes.withColumnRenamed("rep", "end_rep"), "end_rep", "left")
    tree = materialize(tree.drop("key", "up_key"), "tree")
    # The nodes of an edge are turns of its owner.
    edges = tree.where("d > 0").select("*", F.explode(F.expr(f"sequence(up_d div {RUN}, (d - 1) div {RUN})")).alias("run")).withColumnRenamed("owner", "conv")
    inside = sole.select("conv", F.col("d").alias("at"), "bytes", F.col("total").alias("upto"), F.expr(f"(d - 1) div {RUN}").alias("run"))
    nodes = inside.join(edges, ["conv", "run"]).where("up_d < at AND at <= d")
    last = F.col("at") == F.col("d")
    suffix = (F.col("n") - 1) * (F.col("total") - F.col("upto") + F.col("bytes"))
    found = nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("at").alias("depth"),
        F.when(F.col("at") == F.col("up_d") + 1, F.col("up_owner")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") + suffix).alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).alias("ends_sha256"),
    )
    root = tree.where("d = 0").select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("below").alias("saved_tokens"), "ends_sha256"
    )
    return found.unionByName(root).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
