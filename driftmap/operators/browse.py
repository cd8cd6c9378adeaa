"""The data behind the views of an embedding: samples, selections, smoothing, rasters, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.operators.indexing import dense_index


def sample_key(seed: int, index: Column) -> Column:
    """The SHA-256 of seed and row number, as hexadecimal digits: other engines can draw the same."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), index.cast("string")).cast("binary"), 256)


def sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows without replacement (all, if there are fewer), the same for the same seed: those
    with the least ``sample_key``.  Every task keeps its ``n`` least and tasks' samples merge to one, so no
    rows but those are moved or sorted."""
    return rows.orderBy(sample_key(seed, F.col("global_idx")), "global_idx").limit(n)


def in_box(x: Column, y: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Is the point inside: does a ray to the right cross an odd number of edges?  An edge has its lower
    end and not its upper one, so a vertex counts once."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:] + vertices[:1]):
        if y0 == y1:
            continue
        low, high = min(y0, y1), max(y0, y1)
        at = F.lit(x0) + (y - y0) * ((x1 - x0) / (y1 - y0))
        crossings = crossings + ((y >= low) & (y < high) & (x < at)).cast("int")
    return crossings % 2 == 1


def rolling_mean(rows: DataFrame, by: str, value: str, width: int = 50, block: int = 100_000) -> DataFrame:
    """``rows`` with ``rolling``: the centred mean of ``value`` over ``width`` rows in the order of ``by``,
    null until the window is full.  Windows run in blocks of ranks; a block borrows the rows at its edges."""
    ranked = dense_index(rows, [by, "global_idx"], "_rank")
    back, ahead = width // 2, width - width // 2 - 1
    own = F.floor(F.col("_rank") / block)
    blocks = F.array_distinct(F.array(own, F.floor((F.col("_rank") + back) / block), F.floor(F.greatest(F.col("_rank") - ahead, F.lit(0)) / block)))
    copies = ranked.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy("_block").orderBy("_rank").rowsBetween(-back, ahead)
    full = F.count(F.lit(1)).over(w) == width
    rolled = copies.withColumn("rolling", F.when(full, F.avg(value).over(w)))
    return rolled.where("_block = _own").drop("_own", "_block", "_rank")


def raster(rows: DataFrame, x: str, y: str, bins: int, x0: float, x1: float, y0: float, y1: float, value: str | None = None) -> DataFrame:
    """(bx, by, n[, mean_attribute]) over half-open bins of [x0, x1) x [y0, y1)."""
    at = lambda c, low, high: F.floor((F.col(c) - low) / ((high - low) / bins)).cast("int")
    inside = rows.where((F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1))
    aggregates = [F.count(F.lit(1)).alias("n")] + ([F.avg(value).alias("mean_attribute")] if value else [])
    return inside.groupBy(at(x, x0, x1).alias("bx"), at(y, y0, y1).alias("by")).agg(*aggregates)


def background_and_sample(vectors: DataFrame, dim0: int, dim1: int, bins: int, n: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a view of two eigenvectors (k, global_idx, value) shows: all coordinates (global_idx, x, y),
    their raster (bx, by, n) over ``bins`` x ``bins`` equal parts of their own limits, the greatest in the
    last, and the positions of ``n`` sampled rows (global_idx, x, y)."""
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    points = vectors.where(F.col("k").isin(dim0, dim1)).groupBy("global_idx").agg(pick(dim0).alias("x"), pick(dim1).alias("y"))
    limits = points.agg(*[f(c).alias(f"{c}{s}") for c in "xy" for f, s in ((F.min, 0), (F.max, 1))])
    at = lambda c: F.least(F.floor(F.try_divide(F.col(c) - F.col(f"{c}0"), (F.col(f"{c}1") - F.col(f"{c}0")) / bins)), F.lit(bins - 1)).cast("int")
    placed = points.crossJoin(F.broadcast(limits))  # one row
    counted = placed.groupBy(F.coalesce(at("x"), F.lit(0)).alias("bx"), F.coalesce(at("y"), F.lit(0)).alias("by")).agg(F.count(F.lit(1)).alias("n"))
    return points, counted, sample(points, n, seed)


def browser_frame(coordinates: DataFrame, stats: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """(global_idx, x, y, mean, std, variance, attribute, category); ``variance`` is the std, as browsers
    of such data name it.  Without ``attributes`` every row has attribute 1 and category 0."""
    frame = coordinates.join(stats.select("global_idx", "mean", "std"), "global_idx")
    if attributes is None:
        frame = frame.withColumn("attribute", F.lit(1.0)).withColumn("category", F.lit(0))
    else:
        frame = frame.join(attributes.select("global_idx", "attribute", "category"), "global_idx")
    return frame.select("global_idx", "x", "y", "mean", "std", F.col("std").alias("variance"), "attribute", "category")


def axis_limits(vectors: DataFrame) -> DataFrame:
    """(k, low, high)"""
    return vectors.groupBy("k").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def color_scale(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``color``: ``value`` scaled to [0, 1] between its least and greatest."""
    limits = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    scaled = F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low"))
    return rows.join(F.broadcast(limits)).withColumn("color", scaled).drop("_low", "_high")  # one row


def pattern_grid(rows: DataFrame, grid_rows: int, grid_columns: int, pixels: int, seed: int) -> DataFrame:
    """(row, col, global_idx, pattern): a sample laid out in a grid; empty places have zeros."""
    n = grid_rows * grid_columns
    drawn = sample(rows, n, seed).select("global_idx", "pattern")
    placed = drawn.withColumn("_at", F.row_number().over(Window.orderBy("global_idx")) - 1)  # n rows
    places = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("_at"))
    zeros = F.array_repeat(F.lit(0.0), pixels)
    grid = places.join(placed, "_at", "left")
    return grid.select(F.expr(f"int(_at div {grid_columns})").alias("row"), (F.col("_at") % grid_columns).alias("col"), "global_idx", F.coalesce(F.col("pattern").cast("array<double>"), zeros).alias("pattern"))


def equal_blocks(rows: DataFrame, by: str, blocks: int, total: int) -> DataFrame:
    """``rows`` with ``category``: equal blocks of the rows in the order of ``by``."""
    from driftmap.operators.indexing import batch_of

    return dense_index(rows, [by, "global_idx"], "_rank").withColumn("category", batch_of(F.col("_rank"), total, blocks)).drop("_rank")
