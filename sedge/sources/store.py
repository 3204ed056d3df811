"""The document store: Parquet tables of documents, chunks and versions.

Chunks are partitioned by a bucket of their document.  A document's chunks are
written before its row, so a crash never shows a document without them.
Re-indexing writes a whole new generation of the chunks and then appends one
row that names it: readers see the old generation or the new one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _has(self, name: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/{name}").limit(0).count()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def _generation(self) -> int:
        """The newest generation of the chunks (one row for each re-indexing)."""
        return self.spark.read.parquet(f"{self.path}/generations").agg(F.max("generation")).first()[0] if self._has("generations") else 0

    def _chunks(self, generation: int) -> str:
        return f"{self.path}/chunks-{generation}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._chunks(self._generation()) if name == "chunks" else f"{self.path}/{name}")

    def _bucketed(self, chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int"))

    def insert(self, documents: DataFrame, chunks: DataFrame) -> None:
        """Append documents, their chunks and their first versions."""
        self._bucketed(chunks).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self._chunks(self._generation()))
        versions = documents.select("document_id", F.lit("1.0").alias("version"), "checksum", F.current_timestamp().alias("created_at"))
        versions.write.mode("append").parquet(f"{self.path}/versions")
        documents.write.mode("append").parquet(f"{self.path}/documents")

    def insert_new(self, documents: DataFrame, chunks: DataFrame) -> DataFrame:
        """Insert what the store doesn't hold by (owner, checksum); returns the new documents."""
        keys = [F.coalesce(F.col("owner_id"), F.lit("")).alias("o"), F.col("checksum").alias("c")]
        known = self.table("documents") if self._has("documents") else documents.limit(0)
        known = known.select(*keys).distinct()
        # of equal new documents the least id counts, whichever task sees it first
        first = documents.groupBy(*(k.alias(n) for k, n in zip(keys, ("fo", "fc")))).agg(F.min("document_id").alias("document_id")).select("document_id")
        fresh = documents.join(first, "document_id", "left_semi").join(
            known, (F.coalesce(F.col("owner_id"), F.lit("")) == F.col("o")) & (F.col("checksum") == F.col("c")), "left_anti"
        )
        fresh = staged(fresh, "fresh")
        self.insert(fresh, chunks.join(fresh.select("document_id"), "document_id", "left_semi"))
        return fresh

    def reindex(self, chunks: DataFrame) -> None:
        """Replace the chunks of the documents of `chunks` and note when they were checked."""
        old = self._generation()
        ids = chunks.select("document_id").distinct()
        both = self.table("chunks").join(ids, "document_id", "left_anti").unionByName(self._bucketed(chunks), allowMissingColumns=True)
        both.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._chunks(old + 1))
        ids.withColumn("last_checked_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/checks")
        self.spark.range(1).select(F.lit(old + 1).alias("generation")).coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def last_checked(self) -> DataFrame:
        """(document_id, last_checked_at) of the documents that were re-indexed."""
        return self.table("checks").groupBy("document_id").agg(F.max("last_checked_at").alias("last_checked_at"))

    def point(self, document_id, user: str | None = None) -> DataFrame:
        """A document by id, if it is shared or the user's."""
        mine = F.col("owner_id").isNull() | (F.col("owner_id") == user if user else F.lit(False))
        return self.table("documents").where((F.col("document_id") == document_id) & mine)
