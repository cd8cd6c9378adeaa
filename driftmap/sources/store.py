"""Where results are kept: Parquet tables below one folder for each kind.

Tables that belong together are a *version*: they are written side by side into a folder that no reader looks at,
and one rename makes them the newest version, or, where anything failed, none.  A reader that has the path of a
version goes on with it whatever is saved meanwhile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions kept when a new one is saved.
KEPT = 3


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the versions in ``folder``, oldest first."""
    path, files = _files(spark, folder)
    found = [x.getPath() for x in files.listStatus(path)] if files.exists(path) else []
    return [f"{folder.rstrip('/')}/{x.getName()}" for x in sorted(found, key=lambda x: x.getName()) if x.getName().startswith("version=")]


def newest(spark: SparkSession, folder: str) -> str:
    found = versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"nothing is saved in {folder}")
    return found[-1]


def _commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], name: Callable[[], str]) -> str:
    """Write ``tables`` and give their folder the first free one of the names that ``name`` tells."""
    jvm, staging = spark.sparkContext._jvm, f"{folder.rstrip('/')}/.saving-{uuid.uuid4().hex}"
    path, files = _files(spark, staging)
    try:
        for table, df in tables.items():
            df.write.parquet(f"{staging}/{table}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        while True:
            target = f"{folder.rstrip('/')}/{name()}"
            try:  # fails, other than FileSystem.rename, if the target exists
                context.rename(files.makeQualified(path), files.makeQualified(_files(spark, target)[0]), spark.sparkContext._gateway.new_array(kind, 0))
                return target
            except Exception:
                if not files.exists(_files(spark, target)[0]):
                    raise
    finally:
        files.delete(path, True)  # gone already if it was renamed


def save_version(folder: str, tables: dict[str, DataFrame], kept: int = KEPT) -> str:
    """The path of the new version; all but the newest ``kept`` are deleted."""
    spark = next(iter(tables.values())).sparkSession

    def following() -> str:
        found = versions(spark, folder)
        return f"version={int(found[-1].rsplit('=', 1)[1]) + 1 if found else 0:09d}"

    path = _commit(spark, folder, tables, following)
    for old in versions(spark, folder)[:-kept]:
        where, files = _files(spark, old)
        files.delete(where, True)
    return path


def save_similarity(folder: str, knn: DataFrame, stats: DataFrame, mask: DataFrame) -> str:
    """knn, stats, mask and meta as a new version in ``folder``; knn is sorted so that ranks prune."""
    meta = stats.agg(F.count(F.lit(1)).alias("n")).withColumn("time_stamp", F.date_format(F.current_timestamp(), "yyyy_MM_dd_HH_mm_ss"))
    tables = {"knn": knn.repartitionByRange("i").sortWithinPartitions("rank", "i"), "stats": stats.select("global_idx", "mean", "std"), "mask": mask, "meta": meta}
    return save_version(folder, tables)


def load_similarity(spark: SparkSession, folder: str, k: int | None = None, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(knn, stats) of the newest version, or of the one at the path ``version``; only the first ``k`` ranks
    are read if given."""
    path = version or newest(spark, folder)
    knn = spark.read.parquet(f"{path}/knn")
    return (knn.where(F.col("rank") <= k) if k else knn), spark.read.parquet(f"{path}/stats")


def load_mask(spark: SparkSession, folder: str, version: str | None = None) -> list[float]:
    """The stored mask in the order of pixels, as the functions on patterns take it."""
    return [float(r.good) for r in spark.read.parquet(f"{version or newest(spark, folder)}/mask").orderBy("pixel_idx").collect()]  # a row a pixel


def save_patterns(rows: DataFrame, folder: str) -> None:
    """``rows`` in the order of datasets and local numbers, so that ranges of them are few row groups."""
    rows.repartitionByRange("file_idx", "dataset_idx", "local_idx").sortWithinPartitions("file_idx", "dataset_idx", "local_idx").write.mode("overwrite").parquet(folder)


def scan_batch(spark: SparkSession, folder: str, ends: DataFrame) -> DataFrame:
    """The stored patterns of one batch: local rows [start, end) of each dataset in ``ends`` (file_idx,
    dataset_idx, start, end).  The ranges reach the scan as filters."""
    wanted = F.lit(False)
    for r in ends.select("file_idx", "dataset_idx", "start", "end").collect():  # a row a dataset of the batch
        wanted = wanted | ((F.col("file_idx") == r.file_idx) & (F.col("dataset_idx") == r.dataset_idx) & (F.col("local_idx") >= r.start) & (F.col("local_idx") < r.end))
    return spark.read.parquet(folder).where(wanted)


def save_eigensystem(folder: str, values: DataFrame, vectors: DataFrame, neighbours: int, tau: float, keep_diagonal: bool) -> str:
    """A new folder for each run, named by its time; it appears at once and is never overwritten."""
    spark = values.sparkSession
    meta = spark.createDataFrame([(neighbours, float(tau), keep_diagonal)], "neighbour_number int, tau double, keep_diagonal boolean")
    tables = {"eigenvalues": values, "eigenvectors": vectors.sort("k", "global_idx"), "meta": meta}
    return _commit(spark, folder, tables, lambda: f"run_ts={datetime.now():%Y_%m_%d_%H_%M_%S_%f}")


def load_eigenvectors(spark: SparkSession, run: str, dims: list[int] | None = None) -> DataFrame:
    vectors = spark.read.parquet(f"{run}/eigenvectors")
    return vectors.where(F.col("k").isin(dims)) if dims else vectors


def load_attributes(spark: SparkSession, path: str | None, stats: DataFrame) -> DataFrame:
    """(global_idx, attribute, category); ones and zeros for every pattern where there is no file."""
    if path:
        return spark.read.parquet(path).select("global_idx", "attribute", "category")
    return stats.select("global_idx", F.lit(1.0).alias("attribute"), F.lit(0).alias("category"))


def save_selection(selected: DataFrame, path: str) -> None:
    selected.select("global_idx").write.mode("overwrite").parquet(path)
