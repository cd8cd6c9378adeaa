"""Masks and statistics of patterns (``pattern array<double>``)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType


def good_pixels(mask: Column) -> Column:
    """Numbers above a half are good; so is NaN, which Spark orders above all numbers."""
    return F.transform(mask, lambda x: x > 0.5)


def rank_of(kind: DataType) -> int:
    """How deep arrays of this type nest."""
    return 1 + rank_of(kind.elementType) if isinstance(kind, ArrayType) else 0


def flat(pattern: Column, rank: int) -> Column:
    """A pattern of nested arrays as one array of doubles, the last index running fastest."""
    for _ in range(rank - 1):
        pattern = F.flatten(pattern)
    return pattern.cast("array<double>")


def least_and_most(pattern: Column, rank: int) -> list[Column]:
    """(least, greatest) length of the arrays at each depth of a pattern, outermost first; an array of
    longs each."""
    found = []
    for depth in range(rank):
        inner = pattern
        for _ in range(depth - 1):
            inner = F.flatten(inner)
        sizes = F.array(F.size(pattern)) if depth == 0 else F.transform(inner, F.size)
        found.append(F.array(F.array_min(sizes), F.array_max(sizes)).cast("array<long>"))
    return found


def mask_table(spark, mask: list[float]) -> DataFrame:
    """(pixel_idx, good)"""
    values = F.from_json(F.lit(json.dumps([None if x is None else str(x) for x in mask])), "array<string>").cast("array<double>")
    return spark.range(1).select(F.posexplode(good_pixels(values)).alias("pixel_idx", "good"))


def masked(pattern: Column, mask: list[float] | None) -> Column:
    """The good pixels of ``pattern``, as doubles.  The mask is one literal in the plan, however many
    pixels it has; a pattern of another size is an error."""
    values = pattern.cast("array<double>")
    if mask is None or all(not x <= 0.5 for x in mask):
        return values
    good = F.from_json(F.lit(json.dumps([k for k, x in enumerate(mask) if not x <= 0.5])), "array<int>")
    fits = F.transform(good, lambda k: F.get(values, k))
    return F.when(F.size(values) == len(mask), fits).when(values.isNotNull(), F.raise_error(F.lit(f"a pattern doesn't have the {len(mask)} pixels of the mask")))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def with_stats(rows: DataFrame, mask: list[float] | None = None) -> DataFrame:
    """``rows`` with the good pixels in ``pattern`` and their mean and population std."""
    kept = rows.withColumn("pattern", masked(F.col("pattern"), mask)).withColumn("mean", mean_of(F.col("pattern")))
    squares = F.aggregate("pattern", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    return kept.withColumn("std", F.sqrt(squares / F.nullif(F.size("pattern"), F.lit(0))))
