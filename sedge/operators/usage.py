"""Quotas, credits, rate limits and query logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_credits(requests: DataFrame, limit: int = 30, cost: int = 10) -> DataFrame:
    """Requests (subject, ts, request_id) with day, used before them and accepted.

    A constant cost makes the fold a count: the first limit // cost requests
    of a subject's UTC day pass, rejected ones cost nothing.
    """
    day = F.to_date("ts")
    nth = F.row_number().over(Window.partitionBy("subject", "day").orderBy("ts", "request_id"))
    out = requests.withColumn("day", day).withColumn("nth", nth)
    return out.withColumn("accepted", F.col("nth") <= limit // cost).withColumn("used", F.least(F.col("nth"), F.lit(limit // cost)) * cost)


def lifetime_quota(requests: DataFrame, limit: int) -> DataFrame:
    """Requests with accepted: the first `limit` of each subject."""
    nth = F.row_number().over(Window.partitionBy("subject").orderBy("ts", "request_id"))
    return requests.withColumn("nth", nth).withColumn("accepted", F.col("nth") <= limit)


def rate_limits(requests: DataFrame, limit: int, width: str = "1 hour") -> DataFrame:
    """(subject, start, n, over): fixed windows and whether they exceed the limit."""
    counted = requests.groupBy("subject", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("subject", F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def add_usage(usage: DataFrame, added: DataFrame) -> DataFrame:
    """The usage table (day, subject, count) with counts added or inserted."""
    both = usage.select("day", "subject", "count").unionByName(added.select("day", "subject", "count"))
    return both.groupBy("day", "subject").agg(F.sum("count").alias("count"))


def query_popularity(log: DataFrame, limit: int = 200) -> DataFrame:
    """(key, text, n, last): how often each query was asked, case and ends ignored.

    text is the first spelling, `limit` keeps the most recently asked keys.
    """
    key = F.lower(F.trim("text"))
    counted = log.where(key != "").groupBy(key.alias("key")).agg(F.min_by("text", "ts").alias("text"), F.count("*").alias("n"), F.max("ts").alias("last"))
    return counted.orderBy(F.desc("last"), "key").limit(limit)


def personal_statistics(log: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, total, distinct_queries, favourite) of each user's log."""
    n = log.groupBy(user, F.lower(F.trim("text")).alias("key")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    best = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("n"), "first", "key"))
    return n.withColumn("place", best).groupBy(user).agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct_queries"), F.max(F.when(F.col("place") == 1, F.col("key"))).alias("favourite")
    )


def recent(log: DataFrame, keys: list[str], value: str, most: int = 12) -> DataFrame:
    """The last distinct values of each key, newest first."""
    last = log.groupBy(*keys, value).agg(F.max("ts").alias("ts"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), value))
    return last.withColumn("place", place).where(F.col("place") <= most)


def trending(log: DataFrame, limit: int = 5) -> DataFrame:
    """(key, text, n, last): the most asked queries, ties to the one asked first."""
    key = F.lower(F.trim("text"))
    counted = log.where(key != "").groupBy(key.alias("key")).agg(
        F.min_by("text", "ts").alias("text"), F.count("*").alias("n"), F.max("ts").alias("last"), F.min("ts").alias("first")
    )
    return counted.orderBy(F.desc("n"), "first", "key").limit(limit).drop("first")
