"""The driver's tables as the relations of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables whose rows cost much work each.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts in fewer partitions than there are cores is dealt to all.

    Only a table of few row groups (less than a core's share of
    spark.sql.files.maxPartitionBytes each) is dealt, so no large one is shuffled.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with number, title, type, status, language, owner and dates derived from their rows."""
    tail = F.col("doc_id") % 10
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("number"),
        F.substring("text", 1, 60).alias("title"),
        F.concat(F.lit("type-"), "lang").alias("type"),
        F.when(tail == 0, "replaced").when(tail == 1, "expired").otherwise("active").alias("status"),
        F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("owner"), (F.col("doc_id") % 5).cast("string"))).alias("owner_id"),
        F.when(tail == 0, F.col("doc_id") + 1).alias("replaced_by_id"),
        F.timestamp_seconds(1704067200 + F.col("doc_id") * 7919 % 2592000).alias("updated_at"),
        "text",
        F.sha2("text", 256).alias("checksum"),
    )


DOCUMENTS_SQL = """docs AS (
  SELECT doc_id AS document_id, source AS number, substr(text, 1, 60) AS title, 'type-' || lang AS type,
         CASE doc_id % 10 WHEN 0 THEN 'replaced' WHEN 1 THEN 'expired' ELSE 'active' END AS status, lang AS language,
         CASE WHEN doc_id % 3 = 0 THEN 'owner' || (doc_id % 5) END AS owner_id,
         CASE WHEN doc_id % 10 = 0 THEN doc_id + 1 END AS replaced_by_id,
         1704067200 + doc_id * 7919 % 2592000 AS updated, text, sha256(text) AS checksum
  FROM documents)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as chunks: id = 2^32 a document and the line's number."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.where("trim(text) <> ''").select((F.col("doc_id") * 4294967296 + F.col("pos")).alias("id"), F.col("doc_id").alias("document_id"), F.col("pos").alias("page"), "text")


LINES_SQL = """lines AS (
  SELECT doc_id * 4294967296 + pos AS id, doc_id AS document_id, CAST(pos AS INT) AS page, text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
  WHERE trim(text, ' ') <> '')"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests (request_id, subject, ts)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("subject"), F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns as a log of queries; each conversation is a user's."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select(F.col("conv_id").alias("user_id"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"))


LOG_SQL = """log AS (
  SELECT conv_id AS user_id, text, conv_id * 1000 + turn AS ts FROM conversations WHERE role = 'user')"""
