"""Comparison of two large keyed tables by a tree of order-independent digests.

Keys are hashed into ``TOP`` x ``SUB`` leaves. A digest is the number of rows, the exclusive or and
the sum of their hashes, so it doesn't depend on order and is added up before anything is shuffled.
Leaves are only made below tops whose digests differ, and only rows of leaves that differ are joined:
what is shuffled grows with the differences, not with the tables. The lists of tops and leaves have a
fixed bound (2^20 pairs of numbers), so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

TOP, SUB = 1_024, 1_024


def _hashed(rows: DataFrame, key: str, value: str) -> DataFrame:
    place = F.xxhash64(key)
    return rows.select(F.col(key).alias("key"), F.col(value).alias("value"), F.pmod(place, F.lit(TOP)).cast("int").alias("top"), F.pmod(F.floor(place / TOP).cast("long"), F.lit(SUB)).cast("int").alias("sub"), F.xxhash64(key, value).alias("h"))


def _differing(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Groups whose digests aren't the same in both tables."""
    digest = lambda rows, name: rows.groupBy(*by).agg(F.struct(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(2**31))).alias("s")).alias(name))
    return digest(left, "a").join(digest(right, "b"), list(by), "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*by)


def open_rows(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of both tables, hashed, in leaves that differ."""
    tops = F.broadcast(materialise(_differing(left, right, "top"), "tops"))  # TOP rows at most
    left, right = (x.join(tops, "top", "left_semi") for x in (left, right))
    leaves = F.broadcast(materialise(_differing(left, right, "top", "sub"), "leaves"))  # TOP x SUB rows at most
    return left.join(leaves, ["top", "sub"], "left_semi"), right.join(leaves, ["top", "sub"], "left_semi")


def differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left_value, right_value, in_left, in_right) of keys that one table lacks or that have another value; both need (key, value)."""
    a, b = open_rows(_hashed(left, key, value), _hashed(right, key, value))
    a, b = a.select("key", F.col("value").alias("left_value"), F.lit(True).alias("in_left")), b.select("key", F.col("value").alias("right_value"), F.lit(True).alias("in_right"))
    rows = a.join(b, "key", "full_outer").na.fill(False, ["in_left", "in_right"])
    return rows.filter(~(F.col("in_left") & F.col("in_right") & F.col("left_value").eqNullSafe(F.col("right_value")))).withColumnRenamed("key", key)


def reconcile_differences(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(pk, status) of chunks(pk, kb_id) and index(pk, partition) rows that aren't ok: orphan, missing or misplaced."""
    wanted = chunks.select("pk", F.concat(F.lit("kb_"), F.col("kb_id").cast("string")).alias("partition"))
    status = F.when(~F.col("in_left"), "orphan").when(~F.col("in_right"), "missing").otherwise("misplaced")
    return differences(wanted, index, "pk", "partition").select("pk", status.alias("status"))
