"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Bytes that may be broadcast in one join.
BROADCAST_BYTES = 64 << 20


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``left`` to ``right`` (unique in ``on``) with each key of ``left`` dealt over ``salts`` tasks.

    ``spread`` names the columns of ``left`` that decide a row's task.  ``right`` is repeated ``salts``
    times, so it should be the pre-aggregated side.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def row_bytes(df: DataFrame) -> int:
    """About how much a row takes in a hash table: text and arrays count as 64 bytes."""
    sizes = {"boolean": 8, "int": 8, "bigint": 8, "double": 8, "float": 8, "date": 8, "timestamp": 8}
    return 16 + sum(sizes.get(f.dataType.simpleString(), 64) for f in df.schema.fields)


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most about ``most`` bytes, else as it is (a
    shuffled join).  ``df`` is counted, so it should be a written table or cheap."""
    return F.broadcast(df) if df.count() * row_bytes(df) <= most else df
