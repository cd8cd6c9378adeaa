"""Arrays in ``.npy`` files as a Spark data source.

A file is one dataset, named by the file without its suffix; its first axis numbers the patterns.  The header
says where each pattern begins, so a file is read by as many tasks as it has ranges of ``rows_per_task``
patterns, each reading its own bytes, and filters on ``dataset`` and ``local_idx`` cut files and ranges before
any is opened for data.  Files are opened through ``pyarrow.fs``: local or mounted paths, and the stores it knows.

Defined cases: any real or integer type of either byte order becomes double; an array without axes, of objects
or complex numbers, or in column order with more than one axis is an error; an array without rows has none.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "file_idx int, dataset string, local_idx long, shape array<long>, pattern array<double>"
#: Patterns in a task by default, and bytes read at a time.
ROWS_PER_TASK, READ_BYTES = 100_000, 8 << 20


def opened(path: str) -> pa.NativeFile:
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".npy")


@dataclass(frozen=True)
class Header:
    """What a file's header says: ``begin`` is the byte of the first pattern, ``width`` its values."""

    dtype: np.dtype
    shape: tuple[int, ...]
    begin: int

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))


def header(path: str) -> Header:
    with opened(path) as file:
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, columns_first, dtype = read(file)
        if not shape or dtype.kind not in "biuf" or (columns_first and len(shape) > 1):
            raise ValueError(f"{path}: not a row-wise array of real numbers with an axis")
        return Header(dtype, shape, file.tell())


class Range(InputPartition):
    """The patterns ``start`` to ``stop`` (exclusive) of a file."""

    def __init__(self, file_idx: int, path: str, found: Header, start: int, stop: int):
        super().__init__((file_idx, start, stop))
        self.file_idx, self.path, self.found, self.start, self.stop = file_idx, path, found, start, stop


class NpyReader(DataSourceReader):
    def __init__(self, paths: list[str], rows_per_task: int):
        self.paths, self.rows_per_task = paths, rows_per_task
        self.datasets: set[str] | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes ranges of local_idx and values of dataset; all others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == "dataset" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.datasets = wanted if self.datasets is None else self.datasets & wanted
            elif name == "local_idx" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for k, path in enumerate(self.paths):
            if self.datasets is None or stem(path) in self.datasets:
                found = header(path)
                stop = min(self.high, found.shape[0])
                out += [Range(k, path, found, at, min(stop, at + self.rows_per_task)) for at in range(self.low, stop, self.rows_per_task)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is left after the filters
            return
        found = partition.found
        bytes_of = max(1, found.width * found.dtype.itemsize)
        step = max(1, READ_BYTES // bytes_of)
        with opened(partition.path) as file:
            for at in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - at)
                data = file.read_at(n * found.width * found.dtype.itemsize, found.begin + at * found.width * found.dtype.itemsize)
                values = np.frombuffer(data, found.dtype).astype(np.float64)
                ends = np.arange(n + 1, dtype=np.int32)
                shape = np.tile(np.array(found.shape[1:], np.int64), n)
                columns = [
                    pa.array(np.full(n, partition.file_idx, np.int32)),
                    pa.array([stem(partition.path)] * n, pa.string()),
                    pa.array(np.arange(at, at + n)),
                    pa.ListArray.from_arrays(ends * (len(found.shape) - 1), pa.array(shape, pa.int64())),
                    pa.ListArray.from_arrays(ends * found.width, pa.array(values)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["file_idx", "dataset", "local_idx", "shape", "pattern"])


class NpySource(DataSource):
    """Options: ``paths``, a JSON list of files, and ``rows_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(json.loads(self.options["paths"]), int(self.options.get("rows_per_task", ROWS_PER_TASK)))


def read_npy(spark: SparkSession, paths: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """file_idx (place in ``paths``), dataset, local_idx, shape, pattern of all files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; only concerns such sources
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("paths", json.dumps(paths)).option("rows_per_task", rows_per_task).load()


def write_npy(rows: DataFrame, folder: str) -> DataFrame:
    """(path, n): the ``pattern`` arrays of ``rows``, all of one length, in the order of its partitions, in files
    of some thousand patterns each below the existing ``folder``."""
    place = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)
        system.create_dir(root)
        for k, batch in enumerate(x for x in batches if x.num_rows):
            values = np.asarray(batch.column("pattern").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            name = f"part-{TaskContext.get().partitionId():06d}-{k:06d}.npy"
            with system.open_output_stream(f"{root}/{name}") as file:
                np.lib.format.write_array_header_1_0(file, {"descr": "<f8", "fortran_order": False, "shape": values.shape})
                file.write(values.tobytes())
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"{place}/{name}"]), "n": pa.array([batch.num_rows], pa.int64())})

    return rows.select(F.col("pattern").cast("array<double>").alias("pattern")).mapInArrow(run, "path string, n long")
