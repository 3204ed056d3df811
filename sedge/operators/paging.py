"""Deep pages of long listings.

A listing is written once by ranges of its order, each range sorted, with the
number of rows of each range.  The numbers say which ranges a page touches, so
page 1,000 reads one or two of them instead of sorting and skipping all that
stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_path


class Listing:
    """A written listing below `path`, in the order of `order` (names or sort expressions of its columns)."""

    def __init__(self, spark: SparkSession, path: str, order: list[Column | str]):
        self.spark, self.path, self.order = spark, path, order

    @classmethod
    def write(cls, rows: DataFrame, order: list[Column | str], path: str | None = None, ranges: int | None = None) -> Listing:
        """Deal `rows` by ranges of `order`, of which rows should be few equals, and count them."""
        path = path or shared_path(rows.sparkSession, "listing")
        dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
        dealt.withColumn("_range", F.spark_partition_id()).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
        spark = rows.sparkSession
        held = spark.read.parquet(f"{path}/rows") if rows.limit(1).count() else rows.limit(0).withColumn("_range", F.lit(0))
        held.groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
        return cls(spark, path, order)

    def _counts(self) -> list[tuple[int, int]]:
        """A number for each range."""
        return sorted((r[0], r[1]) for r in self.spark.read.parquet(f"{self.path}/counts").collect())

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows `offset` to `offset + limit` of the listing."""
        before, ranges, skipped = 0, [], None
        for number, n in self._counts():
            if before < offset + limit and before + n > offset:
                skipped = before if skipped is None else skipped
                ranges.append(number)
            before += n
        if not ranges:
            return self.spark.read.parquet(f"{self.path}/rows").drop("_range").limit(0) if before else self.spark.createDataFrame([], "id long")
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/_range={r}" for r in ranges))
        return rows.drop("_range").orderBy(*self.order).offset(offset - skipped).limit(limit)
