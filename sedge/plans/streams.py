"""Named queries that run as streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_path
from ..streaming import jobs
from .catalogue import _query

CREDITS, POLL, LEAST = 40, 300, 200


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


@_query(
    f"""WITH RECURSIVE r AS (
  SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS subject, ts, CAST(ceil(value) AS BIGINT) AS cost,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
s AS (
  SELECT request_id, subject, cost, nth, cost <= {CREDITS} AS accepted, CASE WHEN cost <= {CREDITS} THEN cost ELSE 0 END AS used, ts AS since FROM r WHERE nth = 1
  UNION ALL
  SELECT request_id, subject, cost, nth, before + cost <= {CREDITS}, CASE WHEN before + cost <= {CREDITS} THEN before + cost ELSE before END, since FROM (
    SELECT r.request_id, r.subject, r.cost, r.nth, CASE WHEN r.ts >= s.since + INTERVAL 24 HOUR THEN 0 ELSE s.used END AS before,
           CASE WHEN r.ts >= s.since + INTERVAL 24 HOUR THEN r.ts ELSE s.since END AS since
    FROM s JOIN r ON r.subject = s.subject AND r.nth = s.nth + 1))
SELECT request_id, subject, cost, accepted, used, since FROM s"""
)
def credit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of a varying cost, judged by a stream with a quota window for each user."""
    rows = _stream(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("subject"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.ceil("value").cast("long").alias("cost")
    )
    with jobs.state_store(spark):
        out = jobs.run_to_end(jobs.credit_windows(rows, CREDITS), shared_path(spark, "credits"), shared_path(spark, "credits-state"), "append")
    return out.select("request_id", "subject", "cost", "accepted", "used", F.col("since").cast("timestamp_ntz").alias("since"))


@_query(
    f"""WITH d AS (SELECT sha256(text) AS checksum, min(doc_id) AS doc_id FROM documents WHERE length(text) > {LEAST} GROUP BY 1)
SELECT doc_id, checksum, (row_number() OVER (ORDER BY doc_id) - 1) // {POLL} AS poll FROM d"""
)
def poll_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as a stream; each poll takes a limited number, further polls all that waits."""
    rows = _stream(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    rows = rows.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("checksum"), "text")
    job = jobs.PollIngest(shared_path(spark, "ingest"), "id long, checksum string, text string", ["checksum"], POLL, LEAST)
    job.stream(rows, shared_path(spark, "ingest-state")).awaitTermination()
    job.drain(spark)
    order = F.when(F.startswith("poll", F.lit("s")), F.lit(0)).otherwise(F.substring("poll", 2, 9).cast("long") + 1)
    return job.documents(spark).select(F.col("id").alias("doc_id"), "checksum", order.cast("long").alias("poll"))
