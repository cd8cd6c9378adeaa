"""Sparse symmetric graphs and Laplacians as (i, j, w) tables.

Entries that aren't stored are zero.  ``diagonal`` says what a symmetrised graph has on its diagonal:
``keep`` what the neighbour table had, ``zero`` nothing, ``one`` a stored zero for every node, which the
kernel turns into weight one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIAGONALS = ("one", "zero", "keep")


def prune(knn: DataFrame, k: int) -> DataFrame:
    return knn.where(F.col("rank") <= k)


def symmetrize(knn: DataFrame, diagonal: str = "one") -> DataFrame:
    """(i, j, w): the greater of both directions, a missing one counting as zero; zeros aren't stored.
    Rows that repeat a direction are summed, as entries of a sparse matrix are."""
    if diagonal not in DIAGONALS:
        raise ValueError(f"diagonal must be one of {DIAGONALS}")
    there = knn.select("i", "j", F.col("value").alias("there"))
    back = knn.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("back"))
    # Sums of both directions by pair need one shuffle, no join.
    sums = there.unionByName(back, allowMissingColumns=True).groupBy("i", "j").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    zero = F.lit(0.0)
    merged = sums.select("i", "j", F.greatest(F.coalesce("there", zero), F.coalesce("back", zero)).alias("w")).where("w <> 0")
    if diagonal == "keep":
        return merged
    off = merged.where("i <> j")
    if diagonal == "zero":
        return off
    nodes = knn.select("i").unionByName(knn.select(F.col("j").alias("i"))).distinct()
    return off.unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(0.0).alias("w")))


def kernel(graph: DataFrame, tau: float, sign: int = -1) -> DataFrame:
    """Stored entries become exp(sign * w / tau)."""
    return graph.withColumn("w", F.exp(F.col("w") * sign / tau))


def degree(graph: DataFrame) -> DataFrame:
    """(i, deg): column sums."""
    return graph.groupBy(F.col("j").alias("i")).agg(F.sum("w").alias("deg"))


def inverse_degree(graph: DataFrame) -> DataFrame:
    return degree(graph).select("i", (1 / F.nullif("deg", F.lit(0.0))).alias("inv"))


def inverse_sqrt_degree(graph: DataFrame) -> DataFrame:
    return degree(graph).select("i", (1 / F.nullif(F.sqrt("deg"), F.lit(0.0))).alias("inv_sqrt"))


def _from_identity(scaled: DataFrame, nodes: DataFrame, on_diagonal) -> DataFrame:
    """(i, j, l): a diagonal table less ``scaled`` (i, j, w); exact zeros aren't stored."""
    diagonal = nodes.select("i", F.col("i").alias("j"), on_diagonal.alias("l"))
    entries = scaled.select("i", "j", (-F.col("w")).alias("l")).unionByName(diagonal)
    return entries.groupBy("i", "j").agg(F.sum("l").alias("l")).where("l <> 0")


def laplacian(graph: DataFrame, kind: str = "symmetric") -> DataFrame:
    """plain D - W, random_walk I - W/D, symmetric I - W/sqrt(D)sqrt(D), as (i, j, l)."""
    deg = degree(graph)
    if kind == "plain":
        return _from_identity(graph, deg, F.col("deg"))
    if kind == "random_walk":
        scaled = graph.join(deg, "i").select("i", "j", F.try_divide(F.col("w"), F.col("deg")).alias("w"))
    elif kind == "symmetric":
        root = deg.select("i", F.sqrt("deg").alias("ri"))
        other = root.select(F.col("i").alias("j"), F.col("ri").alias("rj"))
        scaled = graph.join(root, "i").join(other, "j").select("i", "j", F.try_divide(F.try_divide(F.col("w"), F.col("ri")), F.col("rj")).alias("w"))
    else:
        raise ValueError("laplacian must be plain, random_walk or symmetric")
    return _from_identity(scaled, deg, F.lit(1.0))


def kernel_first_laplacian(knn: DataFrame, tau: float, sign: int = 1) -> DataFrame:
    """The older order of steps: kernel, then symmetrise, then drop the diagonal."""
    weighted = knn.withColumn("value", F.exp(F.col("value") * sign / tau))
    return laplacian(symmetrize(weighted, "zero"), "symmetric")


def multiply(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, x) of a matrix (i, j, l) times a vector (i, x)."""
    other = vector.select(F.col("i").alias("j"), "x")
    return matrix.join(other, "j").groupBy("i").agg(F.sum(F.col("l") * F.col("x")).alias("x"))


def tau_curve(graph: DataFrame, low: float = -10.0, high: float = 10.0, steps: int = 20) -> DataFrame:
    """(idx, log_eps, eps, density, normalized, gradient) over a grid of scales, one pass over the graph."""
    from pyspark.sql import Window

    scales = [low + k * (high - low) / (steps - 1) for k in range(steps)]
    # One row with a sum for each scale; an edge is no more than one row on the way.
    added = graph.agg(*[F.sum(F.exp(-F.col("w") / math.exp(e))).alias(f"s{k}") for k, e in enumerate(scales)])
    each = [F.struct(F.lit(k).alias("idx"), F.lit(e).alias("log_eps"), F.col(f"s{k}").alias("s")) for k, e in enumerate(scales)]
    sums = added.select(F.explode(F.array(*each)).alias("g")).select("g.idx", "g.log_eps", "g.s")
    curve = sums.select("idx", "log_eps", F.exp("log_eps").alias("eps"), F.log(F.col("s") + 1e-10).alias("density"))
    every, order = Window.partitionBy(), Window.orderBy("idx")
    low_, high_ = F.min("density").over(every), F.max("density").over(every)
    curve = curve.withColumn("normalized", F.try_divide(F.col("density") - low_, high_ - low_))
    after, before = F.lead("normalized").over(order), F.lag("normalized").over(order)
    slope = F.when(before.isNull(), after - F.col("normalized")).when(after.isNull(), F.col("normalized") - before).otherwise((after - before) / 2)
    return curve.withColumn("gradient", slope)


def best_tau(curve: DataFrame) -> DataFrame:
    """(idx, eps, at_edge): where the curve is steepest, the first such place; ``at_edge`` says that it is
    the last of the grid, which then ends too early to tell."""
    from pyspark.sql import Window

    placed = curve.withColumn("at_edge", F.col("idx") == F.max("idx").over(Window.partitionBy()))  # a row for each scale
    return placed.where("gradient IS NOT NULL").orderBy(F.col("gradient").desc(), "idx").limit(1).select("idx", "eps", "at_edge")
