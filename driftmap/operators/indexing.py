"""Dense row numbers, batches and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.functions.joins import checked_broadcast
from driftmap.sources.scratch import materialize


def dense_index(df: DataFrame, order: list, name: str = "global_idx") -> DataFrame:
    """``df`` with numbers 0, 1, ... in ``order``, without a window over all rows: rows are range
    partitioned and sorted, each partition counts its own, and only the counts are summed up."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_part").withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_at", "_base")  # a row for each partition


def global_index_map(rows: DataFrame) -> DataFrame:
    """``rows`` (file_idx, dataset_idx, local_idx, ...) with ``global_idx`` by prefix sums over datasets."""
    counts = rows.groupBy("file_idx", "dataset_idx").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file_idx", "dataset_idx").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("file_idx", "dataset_idx", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(checked_broadcast(bases), ["file_idx", "dataset_idx"]).withColumn("global_idx", F.col("_base") + F.col("local_idx")).drop("_base")


def source_counts(rows: DataFrame) -> DataFrame:
    """Rows by dataset, by file and in all (null: all)."""
    return rows.rollup("file_idx", "dataset_idx").agg(F.count(F.lit(1)).alias("n"))


def batch_sizes(spark, total: int, batches: int) -> DataFrame:
    """(batch, n): ``total`` rows in ``batches`` parts that differ by one at most, larger ones first."""
    n = F.lit(total // batches) + (F.col("id") < total % batches).cast("int")
    return spark.range(batches).select(F.col("id").cast("int").alias("batch"), n.cast("long").alias("n"))


def batch_ranges(spark, total: int, batches: int) -> DataFrame:
    """(batch, start, end), end exclusive."""
    each, more = divmod(total, batches)
    start = F.col("id") * each + F.least(F.col("id"), F.lit(more))
    end = start + each + (F.col("id") < more).cast("int")
    return spark.range(batches).select(F.col("id").cast("int").alias("batch"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def batch_grid(spark, total: int, batches0: int, batches1: int) -> DataFrame:
    """(batch0, batch1, start0, end0, start1, end1): the tiles of all pairs of rows."""
    side = lambda k, n: batch_ranges(spark, total, n).select(F.col("batch").alias(f"batch{k}"), F.col("start").alias(f"start{k}"), F.col("end").alias(f"end{k}"))
    return side(0, batches0).crossJoin(F.broadcast(side(1, batches1)))  # numbers of tiles, no rows of data


def batch_of(index: Column, total: int, batches: int) -> Column:
    """The batch of a row number, by arithmetic."""
    each, more = divmod(total, batches)
    large = more * (each + 1)
    late = F.floor((index - large) / max(each, 1)) + more
    return F.when(index < large, F.floor(index / (each + 1))).otherwise(late).cast("int")


def batch_ends(rows: DataFrame, total: int, batches: int) -> DataFrame:
    """(batch, file_idx, dataset_idx, start, end): the local rows that a batch takes of each dataset."""
    return rows.groupBy(batch_of(F.col("global_idx"), total, batches).alias("batch"), "file_idx", "dataset_idx").agg(F.min("local_idx").alias("start"), (F.max("local_idx") + 1).alias("end"))


def other_batches(spark, batches: int) -> DataFrame:
    """(batch, other): for each batch all the others."""
    ids = spark.range(batches).select(F.col("id").cast("int").alias("batch"))
    return ids.select("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("other")).where("batch <> other")


def lookup(rows: DataFrame, ids: list[int]) -> DataFrame:
    """The rows with the given ``global_idx``, with ``pos`` of each request; repeats stay."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, global_idx long")
    return rows.join(F.broadcast(wanted), "global_idx")  # a caller's list


#: Row numbers in a folder of ``save_indexed``.
BLOCK = 100_000


def save_indexed(rows: DataFrame, folder: str, block: int = BLOCK) -> None:
    """``rows`` with a folder for each ``block`` row numbers, sorted in it, for ``lookup_table``."""
    placed = rows.withColumn("block", F.expr(f"global_idx div {block}"))
    placed.repartitionByRange("block", "global_idx").sortWithinPartitions("block", "global_idx").write.mode("overwrite").partitionBy("block").parquet(folder)


def lookup_table(spark, folder: str, wanted: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``save_indexed`` that ``wanted`` (pos, global_idx) asks for, with ``pos``; repeats stay.

    While ``wanted`` fits a broadcast, only the folders with a wanted number are read (Spark prunes them when
    the broadcast is there); beyond that both sides are shuffled by number, and the optimiser splits numbers
    that are asked for very often.
    """
    asked = checked_broadcast(wanted.where("global_idx >= 0").select("pos", "global_idx", F.expr(f"global_idx div {block}").alias("block")))
    return spark.read.parquet(folder).join(asked, ["block", "global_idx"]).drop("block")


def grouped_positions(found: DataFrame) -> DataFrame:
    """``lookup`` rows with ``out``: their place when read dataset by dataset, in request order there."""
    return dense_index(found, ["file_idx", "dataset_idx", "pos"], "out").withColumn("out", F.col("out").cast("int"))
