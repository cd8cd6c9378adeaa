"""Seeded synthetic patterns with a known structure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pixels(side: int) -> Column:
    return F.sequence(F.lit(0), F.lit(side * side - 1))


def _noise(amplitude: float, seed: int) -> Column:
    """Uniform in [0, amplitude), by pixel ``p`` of row ``id``."""
    return lambda p: F.pmod(F.xxhash64(F.col("id"), p, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0 * amplitude


def squares_and_disks(spark: SparkSession, rows: int, side: int = 128, seed: int = 1, noise: float = 150.0) -> DataFrame:
    """(global_idx, kind, pattern): 51 of every 122 patterns a square of 40, the rest a disk of 68."""
    a, b, centre, radius = side * 45 // 128, side * 72 // 128, (side - 1) / 2, side * 20 / 128
    x, y = (lambda p: p % side), (lambda p: F.floor(p / side))
    square = lambda p: (x(p) >= a) & (x(p) < b) & (y(p) >= a) & (y(p) < b)
    disk = lambda p: (x(p) - centre) * (x(p) - centre) + (y(p) - centre) * (y(p) - centre) <= radius * radius
    is_square = F.col("id") % 122 < 51
    value = lambda p: F.when(is_square, F.when(square(p), 40.0).otherwise(0.0)).otherwise(F.when(disk(p), 68.0).otherwise(0.0)) + _noise(noise, seed)(p)
    return spark.range(rows).select(F.col("id").alias("global_idx"), F.when(is_square, "square").otherwise("disk").alias("kind"), F.transform(_pixels(side), value).alias("pattern"))


def flat_shapes(spark: SparkSession, rounds: int = 20, side: int = 128, seed: int = 4, low: int = 5, high: int = 100, noise: float = 30.0) -> DataFrame:
    """(dataset, local_idx, pattern): in round r dataset 2r of noisy squares and 2r + 1 of noisy disks, with
    low to high - 1 patterns each, chosen by ``seed``."""
    sets = spark.range(2 * rounds).select(F.col("id").alias("set"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(high - low)) + low).alias("many"))
    each = sets.select("set", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("local_idx"))
    rows = each.withColumn("id", F.col("set") * high + F.col("local_idx"))
    x, y = (lambda p: p % side), (lambda p: F.floor(p / side))
    a, b, centre, radius = side * 45 // 128, side * 72 // 128, (side - 1) / 2, side * 20 / 128
    square = lambda p: F.when((x(p) >= a) & (x(p) < b) & (y(p) >= a) & (y(p) < b), 40.0).otherwise(0.0)
    disk = lambda p: F.when((x(p) - centre) * (x(p) - centre) + (y(p) - centre) * (y(p) - centre) <= radius * radius, 68.0).otherwise(0.0)
    value = lambda p: F.when(F.col("set") % 2 == 0, square(p)).otherwise(disk(p)) + _noise(noise, seed)(p)
    return rows.select(F.col("set").cast("string").alias("dataset"), "local_idx", F.transform(_pixels(side), value).alias("pattern"))


def random_disks(spark: SparkSession, rows: int, side: int = 128, seed: int = 2) -> DataFrame:
    """(global_idx, pattern): disks of random centre, radius, amplitude and noise."""
    draw = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    cx, cy, r, amplitude, noise = (draw(k) for k in range(5))
    cx, cy, r = (cx + 1) * (side / 2), (cy + 1) * (side / 2), r * (side / 2)
    inside = lambda p: (p % side - cx) * (p % side - cx) + (F.floor(p / side) - cy) * (F.floor(p / side) - cy) <= r * r
    value = lambda p: F.when(inside(p), amplitude * 10).otherwise(0.0) + _noise(1.0, seed)(p) * noise * (side / 2)
    return spark.range(rows).select(F.col("id").alias("global_idx"), F.transform(_pixels(side), value).alias("pattern"))


def spline_coefficients(image: np.ndarray) -> np.ndarray:
    """The cubic B-spline coefficients whose spline has the values of ``image`` at its places, the image being
    mirrored at its edges: a recursive filter forth and back along each axis (Unser, 1999)."""
    pole = np.sqrt(3.0) - 2.0
    out = np.array(image, float)
    for axis in range(out.ndim):
        c = np.moveaxis(out, axis, 0)  # a view
        n = len(c)
        if n == 1:
            continue
        c *= 6.0
        powers = pole ** np.arange(2 * n - 2)
        mirrored = np.concatenate([c, c[-2:0:-1]])
        c[0] = np.tensordot(powers, mirrored, 1) / (1 - pole ** (2 * n - 2))
        for k in range(1, n):
            c[k] += pole * c[k - 1]
        c[-1] = pole / (pole * pole - 1) * (c[-1] + pole * c[-2])
        for k in range(n - 2, -1, -1):
            c[k] = pole * (c[k + 1] - c[k])
    return out


def sampled(image: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Values of the cubic spline through ``image`` at (ys, xs); zero outside."""
    coefficients = spline_coefficients(image)
    total = np.zeros(ys.shape)

    def weight(t: np.ndarray) -> np.ndarray:
        t = np.abs(t)
        return np.where(t < 1, 2 / 3 - t * t + t**3 / 2, np.maximum(2 - t, 0) ** 3 / 6)

    def mirror(k: np.ndarray, n: int) -> np.ndarray:
        k = np.abs(k) % max(1, 2 * n - 2)
        return np.where(k < n, k, 2 * n - 2 - k)

    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    for dy in range(-1, 3):
        for dx in range(-1, 3):
            y, x = y0 + dy, x0 + dx
            total += coefficients[mirror(y, image.shape[0]), mirror(x, image.shape[1])] * weight(ys - y) * weight(xs - x)
    inside = (ys >= 0) & (ys <= image.shape[0] - 1) & (xs >= 0) & (xs <= image.shape[1] - 1)
    return np.where(inside, total, 0.0)


def centred(image: np.ndarray) -> np.ndarray:
    """``image`` with its centre of mass moved to half its size, by a spline."""
    ys, xs = np.indices(image.shape, dtype=float)
    total = image.sum() or 1.0
    dy, dx = (image * ys).sum() / total - image.shape[0] / 2, (image * xs).sum() / total - image.shape[1] / 2
    return sampled(image, ys + dy, xs + dx)


def rotations(spark: SparkSession, rows: int, side: int = 64, seed: int = 3) -> DataFrame:
    """(global_idx, angle, category, pattern): one image at ``rows`` angles from 0 to 355 degrees, with
    five equal categories of angle: a loop with one parameter."""
    rng = np.random.default_rng(seed)
    ys, xs = np.indices((side, side), dtype=float)
    middle = (side - 1) / 2
    blobs = [(rng.uniform(-0.6, 0.6) * middle + middle, rng.uniform(-0.6, 0.6) * middle + middle, rng.uniform(0.08, 0.2) * side) for _ in range(5)]
    image = centred(sum(np.exp(-((ys - y) ** 2 + (xs - x) ** 2) / (2 * s * s)) for y, x, s in blobs))

    def turn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for angle in np.deg2rad(part["angle"]):
                c, s = np.cos(angle), np.sin(angle)
                out.append(sampled(image, c * (ys - middle) - s * (xs - middle) + middle, s * (ys - middle) + c * (xs - middle) + middle).ravel())
            yield part.assign(pattern=out)

    angles = spark.range(rows).select(F.col("id").alias("global_idx"), (F.col("id") * (355.0 / max(1, rows - 1))).alias("angle"), F.least(F.floor(F.col("id") * 5 / rows), F.lit(4)).cast("int").alias("category"))
    return angles.mapInPandas(turn, "global_idx long, angle double, category int, pattern array<double>")
