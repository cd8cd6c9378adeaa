"""Sums of fixed-size count tables over all partitions of a DataFrame.

Each task adds up its own table and sends it in compressed parts, which are summed in a tree: by part and
64 tasks, by part and 4,096 tasks, then by part.  What reaches the driver has the size of the table,
however large the input is.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.llm import words

PARTS = 64


def summed_table(df: DataFrame, size: int, count: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The int64 sum of the tables of length ``size`` (a multiple of PARTS) that ``count`` yields."""
    width = size // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for table in count(batch):
                total += table
        parts = [zlib.compress(total[k * width : (k + 1) * width].astype("<u4").tobytes(), 1) if total.max() < 2**32 else None for k in range(PARTS)]
        wide = [zlib.compress(total[k * width : (k + 1) * width].astype("<i8").tobytes(), 1) if x is None else None for k, x in enumerate(parts)]
        task = pa.array([TaskContext.get().partitionId()] * PARTS, pa.int64())
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "task": task, "narrow": pa.array(parts, pa.binary()), "wide": pa.array(wide, pa.binary())})
        words.give_back()

    def values(narrow, wide) -> np.ndarray:
        return np.frombuffer(zlib.decompress(narrow), "<u4").astype(np.int64) if narrow is not None else np.frombuffer(zlib.decompress(wide), "<i8")

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for narrow, wide in zip(part["narrow"], part["wide"]):
            total += values(narrow, wide)
        return pd.DataFrame({"part": part["part"].iloc[:1], "task": [0], "narrow": [None], "wide": [zlib.compress(total.tobytes(), 1)]})

    schema = "part int, task long, narrow binary, wide binary"
    partial = df.mapInArrow(run, schema)
    for _ in range(2):
        task = partial.withColumn("task", F.expr("task div 64"))
        partial = task.groupBy("part", "task").applyInPandas(lambda x: add(x).assign(task=x["task"].iloc[:1]), schema)
    out = np.zeros(size, np.int64)
    for row in partial.groupBy("part").applyInPandas(add, schema).collect():
        out[row.part * width : (row.part + 1) * width] = values(row.narrow, row.wide)
    return out
