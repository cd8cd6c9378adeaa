"""Selections and raster pyramids over points stored in Z-order.

A point's key interleaves the bits of its cell in a grid of 2^BITS x 2^BITS cells over given limits (Morton order),
so a square of the grid is one range of keys.  A region is covered by squares: of those wholly inside it every
point is taken, those that its border crosses have their points tested, all others aren't read, as
the ranges reach the scan as filters on the sorted key.

Points outside the limits have the key of the nearest cell; cells at the grid's edge are always tested, and
so are cells nearer to the border than rounding could tell.  Points without x or y are in no region.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.operators.browse import in_box, in_polygon

#: Bits of a cell's number on each axis, and how deep a cover divides the grid.
BITS, DEPTH = 16, 7
#: Ranges of a cover; more are joined over the smallest gaps, whose points are tested.
MOST_RANGES = 128


@dataclass(frozen=True)
class Limits:
    x0: float
    x1: float
    y0: float
    y1: float

    def cell(self, value: Column, axis: str, bits: int = BITS) -> Column:
        low, high = (self.x0, self.x1) if axis == "x" else (self.y0, self.y1)
        at = F.floor((value - low) / ((high - low) / (1 << bits)))
        return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), at)).cast("long")


def spread(v: Column) -> Column:
    """The 16 bits of ``v`` at every second place."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def key_of(x: Column, y: Column, limits: Limits) -> Column:
    return spread(limits.cell(x, "x")).bitwiseOR(F.shiftleft(spread(limits.cell(y, "y")), 1))


def save_points(points: DataFrame, folder: str, limits: Limits) -> None:
    """``points`` (x, y and others) with their ``zkey``, in its order, so that ranges are few row groups."""
    keyed = points.withColumn("zkey", key_of(F.col("x"), F.col("y"), limits))
    keyed.repartitionByRange("zkey").sortWithinPartitions("zkey").write.mode("overwrite").parquet(folder)


# ---- covers


def _crosses(p: tuple[float, float], q: tuple[float, float], box: tuple[float, float, float, float]) -> bool:
    """Has the segment from p to q a point in the box (x0, x1, y0, y1)?"""
    low, high = 0.0, 1.0
    for start, way, least, most in ((p[0], q[0] - p[0], box[0], box[1]), (p[1], q[1] - p[1], box[2], box[3])):
        if way == 0:
            if not least <= start <= most:
                return False
            continue
        a, b = sorted(((least - start) / way, (most - start) / way))
        low, high = max(low, a), min(high, b)
        if low > high:
            return False
    return True


def _inside(x: float, y: float, vertices: list[tuple[float, float]]) -> bool:
    odd = False
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:] + vertices[:1]):
        if y0 != y1 and min(y0, y1) <= y < max(y0, y1) and x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0)):
            odd = not odd
    return odd


def cover(vertices: list[tuple[float, float]], limits: Limits, depth: int = DEPTH) -> list[tuple[int, int, bool]]:
    """(first key, last key, wholly inside) of a polygon, in order."""
    edges, found = list(zip(vertices, vertices[1:] + vertices[:1])), []
    wide, high = limits.x1 - limits.x0, limits.y1 - limits.y0
    slack = (1e-9 * wide, 1e-9 * high)

    def visit(level: int, cx: int, cy: int, code: int) -> None:
        side = 1 << level
        # A cell at the grid's edge also holds what lies beyond it.
        box = (
            limits.x0 + wide * cx / side - slack[0] if cx else float("-inf"),
            limits.x0 + wide * (cx + 1) / side + slack[0] if cx + 1 < side else float("inf"),
            limits.y0 + high * cy / side - slack[1] if cy else float("-inf"),
            limits.y0 + high * (cy + 1) / side + slack[1] if cy + 1 < side else float("inf"),
        )
        border = any(_crosses(p, q, box) for p, q in edges)
        if border and level < depth:
            for k in range(4):
                visit(level + 1, 2 * cx + (k & 1), 2 * cy + (k >> 1), 4 * code + k)
        elif border or _inside(limits.x0 + wide * (cx + 0.5) / side, limits.y0 + high * (cy + 0.5) / side, vertices):
            width = 2 * (BITS - level)
            found.append((code << width, ((code + 1) << width) - 1, not border))

    visit(0, 0, 0, 0)
    merged: list[tuple[int, int, bool]] = []
    for low, high_, whole in sorted(found):
        if merged and merged[-1][1] + 1 == low and merged[-1][2] == whole:
            merged[-1] = (merged[-1][0], high_, whole)
        else:
            merged.append((low, high_, whole))
    while len(merged) > MOST_RANGES:
        k = min(range(len(merged) - 1), key=lambda n: merged[n + 1][1] - merged[n][0])
        merged[k : k + 2] = [(merged[k][0], merged[k + 1][1], False)]
    return merged


def _select(spark: SparkSession, folder: str, ranges: list[tuple[int, int, bool]], test: Callable[[Column, Column], Column]) -> DataFrame:
    def within(chosen: list[tuple[int, int]]) -> Column:
        if len(chosen) < 2:
            return F.col("zkey").between(*chosen[0]) if chosen else F.lit(False)
        return within(chosen[: len(chosen) // 2]) | within(chosen[len(chosen) // 2 :])

    rows = spark.read.parquet(folder).where(within([(a, b) for a, b, _ in ranges]))
    return rows.where(within([(a, b) for a, b, whole in ranges if whole]) | test(F.col("x"), F.col("y"))).where("x IS NOT NULL AND y IS NOT NULL").drop("zkey")


def select_polygon(spark: SparkSession, folder: str, vertices: list[tuple[float, float]], limits: Limits, depth: int = DEPTH) -> DataFrame:
    """The points of ``save_points`` that ``browse.in_polygon`` takes."""
    return _select(spark, folder, cover(vertices, limits, depth), lambda x, y: in_polygon(x, y, vertices))


def select_box(spark: SparkSession, folder: str, x0: float, x1: float, y0: float, y1: float, limits: Limits, depth: int = DEPTH) -> DataFrame:
    """The points of ``save_points`` that ``browse.in_box`` takes, its borders included."""
    return _select(spark, folder, cover([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], limits, depth), lambda x, y: in_box(x, y, x0, x1, y0, y1))


# ---- pyramids


def raster_pyramid(points: DataFrame, limits: Limits, levels: int, value: str | None = None) -> DataFrame:
    """(level, tile, bx, by, n[, total]): counts (and sums of ``value``) over 2^level x 2^level half-open parts of
    the limits, each level added up from the one below.  ``tile`` is the part's Morton key in its level, so
    what a zoom shows is one range of tiles.  Points outside the limits aren't counted."""
    inside = points.where((F.col("x") >= limits.x0) & (F.col("x") < limits.x1) & (F.col("y") >= limits.y0) & (F.col("y") < limits.y1))
    sums = [F.sum("n").alias("n")] + ([F.sum("total").alias("total")] if value else [])
    cells = inside.select(limits.cell(F.col("x"), "x", levels).alias("bx"), limits.cell(F.col("y"), "y", levels).alias("by"), F.lit(1).alias("n"), *([F.col(value).alias("total")] if value else []))
    level = cells.groupBy("bx", "by").agg(*sums)
    found = level.withColumn("level", F.lit(levels))
    for k in range(levels - 1, -1, -1):
        level = level.withColumns({c: F.shiftright(c, 1) for c in ("bx", "by")}).groupBy("bx", "by").agg(*sums)
        found = found.unionByName(level.withColumn("level", F.lit(k)))
    tile = spread(F.col("bx")).bitwiseOR(F.shiftleft(spread(F.col("by")), 1))
    return found.select("level", tile.alias("tile"), F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), "n", *(["total"] if value else []))


def save_pyramid(pyramid: DataFrame, folder: str) -> None:
    """A folder for each level, tiles in order."""
    pyramid.repartitionByRange("level", "tile").sortWithinPartitions("level", "tile").write.mode("overwrite").partitionBy("level").parquet(folder)


def read_tiles(spark: SparkSession, folder: str, level: int, tile: int, zoom: int) -> DataFrame:
    """The parts of ``level`` that lie in part ``tile`` of the coarser level ``zoom``: one range of one folder."""
    width = 2 * (level - zoom)
    return spark.read.parquet(folder).where((F.col("level") == level) & (F.col("tile") >= tile << width) & (F.col("tile") < (tile + 1) << width))
