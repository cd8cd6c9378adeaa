"""Source divergence audit: which terms set a source apart, and how far sources of a language differ.

Each language keeps the terms that at least ``least_docs`` of its documents have.  A term's price in a group
(language, source), or in the whole language, is ``1 + floor(scale * (count + add) / (N + add * V))``: V kept
terms, N their occurrences there.  All is exact integer arithmetic.

* ``pair``: the sum over all kept terms of the absolute difference of two sources' prices.  A term that a
  source hasn't got costs its *baseline* there, so only what differs from the baselines is added up,
  sparsely: V times the difference of the baselines; for each source the correction of its own
  terms against the other's baseline, which depends on nothing but that number and comes from one
  sweep over the source's distinct prices; and for terms of both the rest.  Those meet in cells
  of two blocks of sources and a bucket of terms.
* ``term``: the ``top`` terms by which a source is above its language, by *radix selection* (``radix_top``):
  histograms over ten bits of the values at a time, summed in the tasks, find each group's threshold in
  three rounds; of the terms that tie there, histograms over their next differing UTF-8 byte find
  the first, until few enough are left to be sorted.

Words of a task are counted there by language and source, so a frequent term has one row a task.  The output
has a row for every pair of sources of a language, and no other table grows with the square of anything.

Defined cases: null text, lang and source are ''; a group without terms has baselines only; without kept terms
all pairs have value 0 and there are no terms; repeated rows, and rows with equal or null doc_id, are
documents each; an empty table gives no rows; other columns are ignored, whatever their names.  A text is in
the memory of one task, about twenty times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.functions.joins import checked_broadcast, salted_join
from driftmap.llm import words
from driftmap.operators.indexing import dense_index
from driftmap.sources.scratch import materialize

#: Rows of counts that a task gathers before it sends them.
HELD_ROWS = 400_000
#: Sources in a block, and about how many rows a cell has.
BLOCK, CELL_ROWS = 256, 50_000
#: Bits of a radix digit.
DIGIT = 10
#: Ties up to this number in a group are sorted.
SORTED = 4096

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False
GROUP = ["lang", "source"]


# ---- counts


def _slice_counts(texts: pa.Array, langs: list, sources: list) -> pa.Table:
    """lang, source, term, n, docs of a slice."""
    w = words.Words(texts, _NO_LETTER)
    groups: dict[tuple, int] = {}
    of = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources)], np.int64)
    many = max(1, len(w.names))
    # A document's distinct terms first, then the sums over the documents of a group.
    in_doc, n = np.unique(w.doc * many + w.code, return_counts=True)
    key, at = np.unique(of[in_doc // many] * many + in_doc % many, return_inverse=True)
    names = list(groups)
    which = (key // many).tolist()
    return pa.table(
        {
            "lang": pa.array([names[k][0] for k in which], pa.string()),
            "source": pa.array([names[k][1] for k in which], pa.string()),
            "term": w.names.take(pa.array(key % many)).cast(pa.string()),
            "n": pa.array(np.bincount(at, n, len(key)).astype(np.int64)),
            "docs": pa.array(np.bincount(at, minlength=len(key)).astype(np.int64)),
        }
    )


def _summed(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by([*GROUP, "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return found.rename_columns([c.removesuffix("_sum") for c in found.column_names])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            at = 0
            for texts in words.slices(batch.column("text")):
                own = batch.slice(at, len(texts))
                held.append(_slice_counts(texts, own.column("lang").to_pylist(), own.column("source").to_pylist()))
                at += len(texts)
                rows += len(held[-1])
                if rows > HELD_ROWS:
                    held = [_summed(held)]
                    rows = len(held[0])
                    if 2 * rows > HELD_ROWS:
                        yield from held.pop().select([*GROUP, "term", "n", "docs"]).to_batches(20_000)
                        rows = 0
        if held:
            yield from _summed(held).select([*GROUP, "term", "n", "docs"]).to_batches(20_000)
        words.give_back()

    counted = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column | int, total: Column, kept: Column, add: int, scale: int) -> Column:
    """1 + floor(scale * (count + add) / (total + add * kept)), exactly; null without kept terms."""
    # Decimals, as the product may pass 64 bits.
    above = F.lit(scale).cast("decimal(12,0)") * ((count if isinstance(count, Column) else F.lit(count)) + add).cast("decimal(19,0)")
    below = F.nullif((total + add * kept).cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    return (F.call_function("div", above, below) + 1).cast("long")


# ---- the greatest of each group


def radix_top(rows: DataFrame, group: list[str], value: str, item: str, k: int, bits: int = 30, few: int = SORTED) -> DataFrame:
    """The ``k`` rows of each group (no nulls) with the greatest ``value`` (a long, 0 <= value < 2^bits), ties by the UTF-8
    bytes of ``item`` (different in a group) ascending, with their ``rank``.  ``rows`` are read several
    times, so they should be a written table."""
    state, shift = None, bits
    order = Window.partitionBy(*group)
    while shift > 0:
        width = min(DIGIT, shift)
        shift -= width
        digit = F.shiftright(value, shift).bitwiseAND((1 << width) - 1)
        if state is None:
            inside = rows.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_need", F.lit(k).cast("long"))
        else:
            inside = rows.join(checked_broadcast(state.where("_open")), group).where(F.shiftright(value, shift + width) == F.col("_prefix"))
        bins = inside.groupBy(*group, "_prefix", "_need", digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
        above = F.coalesce(F.sum("_n").over(order.orderBy(F.col("_digit").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        whole, least = F.sum("_n").over(order), F.min("_digit").over(order)
        placed = bins.withColumn("_above", above).withColumn("_whole", whole).withColumn("_least", least)
        # The digit where the need is met; where all are needed, the least one.
        met = placed.where("(_above < _need AND _above + _n >= _need) OR (_whole < _need AND _digit = _least)")
        step = met.select(
            *group,
            (F.shiftleft("_prefix", width) + F.col("_digit")).alias("_prefix"),
            (F.col("_need") - F.col("_above")).alias("_need"),
            F.col("_n").alias("_count"),
            (F.col("_above") + F.col("_n") > F.col("_need")).alias("_open"),
            F.lit(shift).alias("_shift"),
        )
        state = materialize(step if state is None else step.unionByName(state.where("NOT _open")), "radix")
    facts = checked_broadcast(state.withColumnRenamed("_open", "_tied"))
    met = rows.join(facts, group)
    own = F.expr(f"shiftright({value}, _shift)")
    sure = met.where((own > F.col("_prefix")) | ((own == F.col("_prefix")) & ~F.col("_tied"))).select(rows.columns)
    ties = first_by_bytes(rows, state.where("_open"), group, value, item, few)
    chosen = sure.unionByName(ties)
    rank = F.row_number().over(order.orderBy(F.col(value).desc(), item))  # k rows a group
    return chosen.withColumn("rank", rank)


def first_by_bytes(rows: DataFrame, state: DataFrame, group: list[str], value: str, item: str, few: int) -> DataFrame:
    """Of each group's rows with the value ``_prefix`` the ``_need`` first by the bytes of ``item``.

    A bound grows byte by byte: items below it are taken, those that begin with it are in question.
    """
    order = Window.partitionBy(*group)
    bound = state.select(*group, F.col("_prefix").alias("_value"), F.col("_need"), F.col("_count"), F.lit(b"").alias("_bound"))
    bytes_of = F.encode(item, "UTF-8")
    while True:
        many = bound.where(f"_need > 0 AND _count > {few}")
        if many.isEmpty():
            break
        tied = rows.join(checked_broadcast(many), group).where((F.col(value) == F.col("_value")) & F.startswith(bytes_of, F.col("_bound"))).withColumn("_bytes", bytes_of)
        ends = tied.groupBy(*group).agg(F.min("_bytes").alias("_low"), F.max("_bytes").alias("_high"))
        # Bytes that all in question share are skipped.
        same = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.octet_length("_low") + 1), lambda k: ~F.substring("_low", k, F.lit(1)).eqNullSafe(F.substring("_high", k, F.lit(1))))) - 1, F.octet_length("_low"))
        skip = materialize(ends.select(*group, same.alias("_skip")), "radix-skip")
        digits = tied.join(checked_broadcast(skip), group).select(*group, "_value", "_need", F.substring("_bytes", F.lit(1), F.col("_skip")).alias("_head"), F.substring("_bytes", F.col("_skip") + 1, F.lit(1)).alias("_digit"))
        bins = digits.groupBy(*group, "_value", "_need", "_head", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        above = F.coalesce(F.sum("_n").over(order.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = bins.withColumn("_above", above).where("_above < _need AND _above + _n >= _need")
        # An item that ends here is met alone: all up to it are taken.
        ended = F.octet_length("_digit") == 0
        after = F.concat("_head", F.when(ended, F.lit(b"\x00")).otherwise(F.col("_digit")))
        step = met.select(*group, "_value", F.when(ended, 0).otherwise(F.col("_need") - F.col("_above")).cast("long").alias("_need"), F.col("_n").alias("_count"), after.alias("_bound"))
        bound = materialize(step.unionByName(bound.join(checked_broadcast(many.select(*group)), group, "left_anti")), "radix-bound")
    met = rows.join(checked_broadcast(bound), group).where(F.col(value) == F.col("_value")).withColumn("_bytes", bytes_of)
    below = met.where(F.col("_bytes") < F.col("_bound")).select(rows.columns)
    open_ = met.where(F.startswith("_bytes", F.col("_bound")) & (F.col("_need") > 0))
    placed = open_.withColumn("_at", F.row_number().over(order.orderBy("_bytes")))  # ``few`` rows a group at most
    return below.unionByName(placed.where("_at <= _need").select(rows.columns))


# ---- pairs of sources


def _cell(table: pa.Table) -> pa.Table:
    """(low, high, both): what the terms that two sources share add to their baselines' corrections."""
    sid, side, p, base = (table.column(c).to_numpy() for c in ("sid", "side", "p", "base"))
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    ids, at = np.unique(sid, return_inverse=True)
    both = np.zeros((len(ids), len(ids)), np.int64)
    order = np.argsort(term, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(term[order])) + 1, [len(order)]))
    for a, b in zip(edges[:-1], edges[1:]):
        own = order[a:b]
        x, y = own[(side[own] & 1) > 0], own[(side[own] & 2) > 0]
        if len(x) and len(y):
            px, py, bx, by = p[x, None], p[None, y], base[x, None], base[None, y]
            both[at[x, None], at[None, y]] += np.abs(px - py) - np.abs(px - by) - np.abs(bx - py) + np.abs(bx - by)
    low, high = np.nonzero(both)
    keep = ids[low] < ids[high]
    low, high = low[keep], high[keep]
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(low), pa.string()), "low": ids[low], "high": ids[high], "both": both[low, high]})


def shared_terms(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, low, high, both) of pairs of sources with terms in common, by number."""
    sizes = priced.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    plan = groups.groupBy("lang").agg(F.max("sid").alias("_last")).join(sizes, "lang")
    blocks = F.floor(F.col("_last") / BLOCK).cast("int") + 1
    facts = checked_broadcast(materialize(plan.select("lang", blocks.alias("_blocks"), F.expr(f"int(_rows div {CELL_ROWS} + 1)").alias("_buckets")), "cells"))
    own = F.floor(F.col("sid") / BLOCK).cast("int")
    spread = priced.join(facts, "lang").select("lang", "sid", "term", "p", "base", own.alias("own"), F.pmod(F.xxhash64("term"), F.col("_buckets")).alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cells = spread.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "bucket", "sid", side.alias("side"), "term", "p", "base")
    found = cells.groupBy("lang", "a", "b", "bucket").applyInArrow(_cell, "lang string, low long, high long, both long")
    return found.groupBy("lang", "low", "high").agg(F.sum("both").alias("both"))


def one_sided(priced: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (lang, sid, base, other, other_base) with ``alone``: the sum over the own terms of
    |p - other_base| - |base - other_base|.  Prices are above the own baseline, so a sweep over the
    source's distinct prices, with the other baselines among them, has all the sums."""
    steps = priced.groupBy("lang", "sid", "p").agg(F.count(F.lit(1)).alias("_m"), F.max("base").alias("base"))
    marks = pairs.select("lang", "sid", "base", F.col("other_base").alias("p"), "other", F.lit(0).cast("long").alias("_m"))
    both = steps.withColumn("other", F.lit(None).cast("long")).unionByName(marks)
    order = Window.partitionBy("lang", "sid").orderBy("p", F.col("other").asc_nulls_first())
    every = Window.partitionBy("lang", "sid")
    gain = F.col("_m") * (F.col("p") - F.col("base"))
    swept = both.withColumn("_n", F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_gain", F.sum(F.when(F.col("other").isNull(), gain).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    swept = swept.withColumn("_all", F.sum("_m").over(every)).withColumn("_gains", F.sum(F.when(F.col("other").isNull(), gain).otherwise(0)).over(every))
    # Below the other baseline a term comes nearer by p - base; above, it passes it: p - base less twice the gap.
    gap = F.greatest(F.col("p") - F.col("base"), F.lit(0))
    low = F.when(F.col("p") > F.col("base"), F.col("_gain")).otherwise(0)
    alone = F.col("_gains") - 2 * low - 2 * gap * F.when(F.col("p") > F.col("base"), F.col("_all") - F.col("_n")).otherwise(0)
    return swept.where("other IS NOT NULL").select("lang", "sid", "other", alone.alias("alone"))


# ---- the audit


def source_divergence(docs: DataFrame, least_docs: int = 30, add: int = 5, scale: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: see above; ``rank`` counts from 1 in each group and part, by value
    descending and then the UTF-8 bytes of item."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    counts = materialize(term_counts(texts), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    kept = materialize(kept.select("lang", "term", "total"), "kept-terms")
    langs = materialize(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("total").alias("lang_n")), "langs")
    occurring = materialize(counts.join(checked_broadcast(kept), ["lang", "term"]).select(*GROUP, "term", "n", "total"), "occurring")
    sums = occurring.groupBy(*GROUP).agg(F.sum("n").alias("group_n"))
    groups = texts.select(*GROUP).distinct().join(sums, GROUP, "left").join(checked_broadcast(langs), "lang", "left")
    groups = groups.select(*GROUP, F.coalesce("group_n", F.lit(0)).alias("group_n"), F.coalesce("V", F.lit(0)).alias("V"), "lang_n")
    groups = groups.withColumn("base", price(0, F.col("group_n"), F.col("V"), add, scale))
    groups = materialize(dense_index(groups, GROUP, "place"), "groups")
    first = groups.groupBy("lang").agg(F.min("place").alias("first"))
    groups = materialize(groups.join(checked_broadcast(first), "lang").withColumn("sid", F.col("place") - F.col("first")).drop("place", "first"), "numbered-groups")
    facts = groups.select(*GROUP, "sid", "group_n", "V", "lang_n", "base")
    few = checked_broadcast(facts)
    met = occurring.join(few, GROUP) if few is not facts else salted_join(occurring, facts, GROUP, ["term"])
    priced = materialize(
        met.select(*GROUP, "sid", "term", "base", price(F.col("n"), F.col("group_n"), F.col("V"), add, scale).alias("p"), price(F.col("total"), F.col("lang_n"), F.col("V"), add, scale).alias("q")),
        "priced",
    )
    rising = materialize(priced.where("p > q").select(*GROUP, (F.col("p") - F.col("q")).alias("value"), F.col("term").alias("item")), "rising")
    terms = radix_top(rising, GROUP, "value", "item", top, bits=max(1, scale.bit_length()))
    other = groups.select("lang", F.col("sid").alias("other"), F.col("base").alias("other_base"), F.col("source").alias("item"))
    near = checked_broadcast(other)
    # The output's rows: every other source of the language.
    pairs = (groups.join(near, "lang") if near is not other else salted_join(groups, other, ["lang"], ["sid"])).where("sid <> other")
    pairs = materialize(pairs.select(*GROUP, "sid", "base", "V", "other", "other_base", "item"), "source-pairs")
    alone = materialize(one_sided(priced, pairs.where("V > 0").select("lang", "sid", "base", "other", "other_base")), "one-sided")
    both = materialize(shared_terms(priced, groups), "shared-terms")
    ends = [F.least("sid", "other").alias("low"), F.greatest("sid", "other").alias("high")]
    apart = alone.select("lang", *ends, "alone").groupBy("lang", "low", "high").agg(F.sum("alone").alias("alone"))
    sums = apart.join(both, ["lang", "low", "high"], "left")
    named = pairs.select("*", *ends).join(sums, ["lang", "low", "high"], "left")
    value = F.coalesce(F.col("V") * F.abs(F.col("base") - F.col("other_base")), F.lit(0)) + F.coalesce("alone", F.lit(0)) + F.coalesce("both", F.lit(0))
    valued = named.select(*GROUP, value.cast("long").alias("value"), "item")
    placed = materialize(dense_index(valued, [*GROUP, F.col("value").desc(), "item"], "place"), "ranked-pairs")
    begin = placed.groupBy(*GROUP).agg(F.min("place").alias("first"))
    ranked = placed.join(checked_broadcast(begin), GROUP).withColumn("rank", (F.col("place") - F.col("first") + 1).cast("int"))
    shape = lambda df, part: df.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shape(ranked, "pair").unionByName(shape(terms, "term"))
