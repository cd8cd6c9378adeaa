"""Manifests: which files and datasets a run reads, and the pattern table they give.

A manifest is a text of lines ``File:<path>`` and ``Dataset:<name>``.  Lines are stripped, empty ones
and those that begin with ``#`` skipped; a dataset belongs to the file line before it and is ignored
before the first; other lines are ignored; a file without datasets gives all its datasets by name.
A path that occurs twice, is missing, has no rows or another pattern shape than the rest is an error.

Patterns are ``.npy`` files (see ``npy``; a file is one dataset) or Parquet tables with ``dataset``, ``local_idx`` and ``pattern``, an array, or arrays in arrays
for patterns of more dimensions, which are flattened with the last index running fastest.  The files
are described by one job and read by another, however many they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.functions.joins import checked_broadcast
from driftmap.operators.indexing import global_index_map
from driftmap.operators.pixels import flat, least_and_most, rank_of
from driftmap.sources.npy import header, read_npy
from driftmap.sources.scratch import materialize

FORMATS = ("parquet", "npy")


def parse_manifest(lines: list[str]) -> list[tuple[str, list[str]]]:
    """(file, its datasets) in order; no datasets means all."""
    found: list[tuple[str, list[str]]] = []
    for line in map(str.strip, lines):
        if line.startswith("File:"):
            path = line.removeprefix("File:")
            if any(path == known for known, _ in found):
                raise ValueError(f"file listed twice: {path}")
            found.append((path, []))
        elif line.startswith("Dataset:") and found:
            found[-1][1].append(line.removeprefix("Dataset:"))
    if not found:
        raise ValueError("the manifest lists no files")
    return found


@dataclass(frozen=True)
class PatternSource:
    """``rows``: global_idx, file_idx, dataset_idx, local_idx, pattern; ``manifest``: one row a dataset."""

    rows: DataFrame
    manifest: DataFrame
    shape: tuple[int, ...]


def same_form(uri: Column) -> Column:
    """URIs with an empty authority in one spelling: file:///x as file:/x."""
    return F.regexp_replace(uri, "^([A-Za-z][A-Za-z0-9+.-]*):///+", "$1:/")


def listed_files(spark: SparkSession, paths: list[str], files: DataFrame) -> DataFrame:
    """(own, file_idx): the listed path that each of ``files`` (own, URIs of part files) is or lies below."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for k, path in enumerate(paths):
        place = jvm.org.apache.hadoop.fs.Path(path)
        rows.append((k, place.getFileSystem(conf).makeQualified(place).toUri().toString()))
    folders = {f"{place.rstrip('/')}/" for _, place in rows}
    if any(f"{'/'.join(place.split('/')[:k])}/" in folders for _, place in rows for k in range(1, len(place.rstrip('/').split('/')))):
        raise ValueError("a listed path lies below another one")
    listed = spark.createDataFrame(rows, "file_idx int, place string").select("file_idx", same_form(F.rtrim("place", F.lit("/"))).alias("place"))
    parts = F.split("own", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))  # the file and all folders over it
    return files.select("own", F.explode(above).alias("place")).join(listed, "place").groupBy("own").agg(F.max_by("file_idx", F.length("place")).alias("file_idx"))


def _parquet_patterns(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, int, list[Column]]:
    """file_idx, dataset, local_idx, pattern of Parquet tables, how deep their patterns nest, and the
    aggregates that tell their shapes."""
    for path in paths:
        spark.read.parquet(path)  # a missing file is an error before any job
    table = spark.read.parquet(*paths)
    rank = rank_of(table.schema["pattern"].dataType)
    own = same_form(F.col("_metadata.file_path"))
    placed = table.select("dataset", "local_idx", "pattern", own.alias("own"))
    owners = listed_files(spark, paths, table.select(own.alias("own")).distinct())
    named = placed.join(checked_broadcast(materialize(owners, "listed-files")), "own")
    return named, rank, [x for k, pair in enumerate(least_and_most(F.col("pattern"), rank)) for x in (F.min(pair[0]).alias(f"low{k}"), F.max(pair[1]).alias(f"high{k}"))]


def read_patterns(spark: SparkSession, manifest: str, fmt: str = "parquet") -> PatternSource:
    """The patterns that the manifest text at the path ``manifest`` lists."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    lines = [r.value for r in spark.read.text(manifest, wholetext=False).collect()]  # one small file
    listed = parse_manifest(lines)
    if fmt == "npy":
        named = read_npy(spark, [path for path, _ in listed])
        rank = len(header(listed[0][0]).shape) - 1
        lengths = [x for k in range(rank) for x in (F.min(F.get("shape", F.lit(k))).alias(f"low{k}"), F.max(F.get("shape", F.lit(k))).alias(f"high{k}"))]
        lengths += [F.min(F.size("shape")).alias("least_rank"), F.max(F.size("shape")).alias("most_rank")]
    else:
        named, rank, lengths = _parquet_patterns(spark, [path for path, _ in listed])
    counts = {(r.file_idx, r.dataset): r for r in named.groupBy("file_idx", "dataset").agg(F.count(F.lit(1)).alias("n"), *lengths).collect()}  # a row a dataset
    facts, shape, seen = [], None, {f for f, _ in counts}
    for file_idx, (path, names) in enumerate(listed):
        if file_idx not in seen:
            raise ValueError(f"no patterns in {path}")
        for dataset_idx, name in enumerate(names or sorted(d for f, d in counts if f == file_idx)):
            if (file_idx, name) not in counts:
                raise ValueError(f"no dataset {name!r} in {path}")
            found = counts[file_idx, name].asDict()
            low, high = (tuple(found[f"{end}{k}"] for k in range(rank)) for end in ("low", "high"))
            shape = shape or low
            if low != shape or high != shape or found.get("least_rank", rank) != rank or found.get("most_rank", rank) != rank:
                raise ValueError(f"patterns of {name!r} in {path} have another shape")
            facts.append((file_idx, path, dataset_idx, name, found["n"]))
    table_of = spark.createDataFrame(facts, "file_idx int, file string, dataset_idx int, dataset string, data_num long")
    wanted = named.join(checked_broadcast(table_of.select("file_idx", "dataset_idx", "dataset")), ["file_idx", "dataset"])
    rows = wanted.select("file_idx", "dataset_idx", F.col("local_idx").cast("long").alias("local_idx"), flat(F.col("pattern"), 1 if fmt == "npy" else rank).alias("pattern"))
    return PatternSource(global_index_map(rows), table_of, shape)


def write_manifest(spark: SparkSession, paths: list[str], out: str) -> None:
    """A ``File:`` line for each path, in case-insensitive order."""
    rows = [(f"File:{p}",) for p in sorted(paths, key=str.lower)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(out)


def list_tables(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """Paths in ``folder`` (not below it) that end in ``suffix``, in case-insensitive order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().toString() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted((p for p in found if p.endswith(suffix)), key=str.lower)
