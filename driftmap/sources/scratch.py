"""Intermediate tables in the folder that all executors share.

A written table cuts lineage and survives the loss of any executor.  The folder is the one that the
cluster names in ``spark.checkpoint.dir``; only where that setting is absent and all runs in one local
process (tests, a laptop) is a folder made here.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.functions.joins import BROADCAST_BYTES

_made: list[tuple[SparkSession, str]] = []
_own_folder: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder, as a URI that Spark's file systems understand."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="driftmap-"))
    return _own_folder[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed when the session's process ends."""
    path = f"{scratch_root(spark)}/driftmap/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of one bitmap.
BITS = 32_768


def _place(row: str) -> tuple[Column, Column]:
    """The bitmap of a row number, and its bit there."""
    return F.shiftright(row, 15), F.col(row).bitwiseAND(BITS - 1)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a number for each row in a new column, and that column's name.  A number stays with
    its row however often, and on whatever executors, the table is read: rows of files are numbered by
    file and place; where that gives some number twice, or ``df`` isn't read from files, it is written.

    Neighbouring rows of a file have neighbouring numbers, so bitmaps tell whether a number occurs twice,
    and what is shuffled for it is about a bit a row."""
    column = free_name(df, "row")
    with contextlib.suppress(AnalysisException):  # no such columns
        placed = df.withColumn(column, F.xxhash64("_metadata.file_path").bitwiseXOR(F.col("_metadata.row_index")))
        bucket, bit = _place(column)
        maps = placed.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_construct_agg("bit")).alias("found"))
        if maps.where("n <> found").isEmpty():
            return placed, column
    return materialize(df.withColumn(column, F.monotonically_increasing_id()), name), column


def with_marks(df: DataFrame, row: str, marked: DataFrame, mark: str, most: int = 1) -> DataFrame:
    """``df`` with an int column ``mark``: that of the row in ``marked`` (the columns ``row`` and ``mark``,
    1 to ``most``, rows at most once), else 0.

    Marks travel as bitmaps, one for each binary digit, a bit a row or less, and are broadcast up to 64 MB of
    them; so the rows of ``df`` stay where they are up to half a billion rows of it (for ``most`` = 1)."""
    digits = range(most.bit_length())
    bucket, bit = _place(row)
    set_ = marked.select(bucket.alias("_bucket"), bit.alias("_bit"), F.col(mark).cast("int").alias("_mark"))
    maps = [F.bitmap_construct_agg(F.when(F.shiftright("_mark", k).bitwiseAND(1) == 1, F.col("_bit"))).alias(f"_map{k}") for k in digits]
    found = materialize(set_.groupBy("_bucket").agg(*maps), "marks")
    if found.count() * (BITS // 8 + 16) * len(digits) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    met = df.join(found, bucket == F.col("_bucket"), "left")
    byte = lambda k: F.conv(F.hex(F.substring(f"_map{k}", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    value = F.lit(0)
    for k in digits:
        own = F.coalesce(F.getbit(byte(k), bit.bitwiseAND(7).cast("int")).cast("int"), F.lit(0))
        value = value + F.shiftleft(own, k)
    return met.withColumn(mark, F.when(F.col("_bucket").isNull(), 0).otherwise(value)).drop("_bucket", *[f"_map{k}" for k in digits])


def without(df: DataFrame, row: str, gone: DataFrame, since: int) -> DataFrame:
    """``df`` less the rows numbered in ``gone``, and without that column; frees the scratch tables made
    after the mark ``since``."""
    mark = free_name(df, "gone")
    kept = with_marks(df, row, gone.select(row, F.lit(1).alias(mark)), mark)
    release(since, -1)
    return kept.where(F.col(mark) == 0).drop(row, mark)


def made() -> int:
    """How many scratch tables there are: a mark for ``release``."""
    return len(_made)


def release(since: int = 0, upto: int | None = None) -> None:
    """Delete the scratch tables of this process from the mark ``since`` on, all but those after ``upto``."""
    gone = _made[since:upto]
    del _made[since:upto]
    for spark, path in gone:
        with contextlib.suppress(Exception):  # the session may have ended first
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up() -> None:
    release()
    while _own_folder:
        shutil.rmtree(_own_folder.pop().removeprefix("file://"), ignore_errors=True)


atexit.register(clean_up)
