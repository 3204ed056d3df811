"""Exact ranks within keys, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def exact_ranks(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """`rows` with their place (from 1) within `keys` by `order`; a null key is a key.

    Rows are dealt by range of keys and order, so a key with very many rows
    stands in many parts, none of which is sorted with another.  A row's rank
    is its place in its part and the number of the key's rows in parts before.
    A part begins with at most one key that goes on from the part before, so
    these numbers are at most one row for each part.  Rows that are equal in
    keys and order have any order among themselves, as in a window.
    """
    by = [*keys, *order]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("_ahead", F.sum("_n").over(before)).where("_ahead > 0")
    ahead = F.broadcast(ahead.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.col("_part").alias("_in"), "_ahead"))
    same = F.col("_part") == F.col("_in")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    out = dealt.withColumn("_place", place).join(ahead, same, "left")
    return out.select(*rows.columns, (F.col("_place") + F.coalesce("_ahead", F.lit(0))).alias(name))
