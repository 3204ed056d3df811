"""Reciprocal-rank fusion, relevance labels and confidence guards.

Two profiles that are never blended: `server` fuses one lexical and one dense
list, `client` one dense list and a lexical list for each query variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import exact_ranks

RRF_K = 60


def _rank(order: list, *partition: str) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def server_fusion(lexical: DataFrame, dense: DataFrame, pool: int = 30, top: int = 10, places: int = 9) -> DataFrame:
    """query_id, id, bm, vec, rrf, fusion, percent, label, rank.

    Both inputs are (query_id, id, score).  An id in either list counts; scores
    boost ranks by 0.15 and 0.20 of their share of the best; the best `pool`
    are blended 55:45 with the vector score where there is one.  `places`
    rounds what ranks are taken from, ties go to the smaller id.
    """
    a = lexical.select("query_id", "id", F.col("score").alias("bm"), _rank([F.desc("score"), "id"], "query_id").alias("bm_rank"))
    b = dense.select("query_id", "id", F.col("score").alias("vec"), _rank([F.desc("score"), "id"], "query_id").alias("vec_rank"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    by = Window.partitionBy("query_id")
    most = lambda c: F.coalesce(F.nullif(F.max(F.coalesce(c, F.lit(0.0))).over(by), F.lit(0.0)), F.lit(1.0))
    both = both.withColumns({"max_bm": most("bm"), "max_vec": most("vec")})
    part = lambda rank, score, m, w: F.when(F.col(rank).isNotNull(), 1 / (RRF_K + F.col(rank)) + w * F.col(score) / F.col(m)).otherwise(0.0)
    rrf = F.round(part("bm_rank", "bm", "max_bm", 0.15) + part("vec_rank", "vec", "max_vec", 0.20), places)
    both = both.withColumn("rrf", rrf).withColumn("place", _rank([F.desc("rrf"), "id"], "query_id")).where(F.col("place") <= pool)
    best = F.coalesce(F.nullif(F.max("rrf").over(by), F.lit(0.0)), F.lit(1.0))
    share = F.col("rrf") / best
    blend = F.when(F.coalesce("vec", F.lit(0.0)) != 0, 0.55 * share + 0.45 * F.col("vec") / F.col("max_vec")).otherwise(share)
    both = both.withColumn("fusion", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)), places))
    both = both.withColumn("rank", _rank([F.desc("fusion"), "id"], "query_id")).where(F.col("rank") <= top)
    return both.select("query_id", "id", "bm", "vec", "rrf", "fusion", server_percent(F.col("fusion")).alias("percent"), server_label(server_percent(F.col("fusion"))).alias("label"), "rank")


def client_fusion(lexical: DataFrame, dense: DataFrame, top: int = 10, places: int = 9) -> DataFrame:
    """query_id, id, bm, vec, rrf, percent, label, rank.

    `lexical` is (query_id, variant, id, score), `dense` (query_id, id, score)
    over all vectors, which are ranked in parts.  Order is by rrf alone,
    percent also by the vector.
    """
    lexical = exact_ranks(lexical.select("query_id", "variant", "id", "score"), ["query_id", "variant"], [F.desc("score"), "id"], "r")
    dense = exact_ranks(dense.select("query_id", "id", "score"), ["query_id"], [F.desc("score"), "id"], "r")
    ranked = lexical.select("query_id", "id", F.col("score").alias("bm"), F.lit(None).cast("double").alias("vec"), "r")
    ranked = ranked.unionByName(dense.select("query_id", "id", F.lit(None).cast("double").alias("bm"), F.col("score").alias("vec"), "r"))
    fused = ranked.groupBy("query_id", "id").agg(F.max("bm").alias("bm"), F.max("vec").alias("vec"), F.round(F.sum(1 / (RRF_K + F.col("r"))), places).alias("rrf"))
    # the best are cut within each task before a query's rows meet
    fused = fused.withColumn("rank", _rank([F.desc("rrf"), "id"], "query_id")).where(F.col("rank") <= top)
    fused = fused.withColumn("best", F.max("rrf").over(Window.partitionBy("query_id")))
    combined = 0.6 * F.col("rrf") / F.col("best") + 0.4 * F.coalesce("vec", F.lit(0.0))
    percent = F.greatest(F.lit(10), F.least(F.lit(98), F.floor(F.round(10 + 88 * combined, 6) + 0.5))).cast("int")
    return fused.select("query_id", "id", "bm", "vec", "rrf", percent.alias("percent"), client_label(percent).alias("label"), "rank")


def server_percent(score: Column) -> Column:
    return F.greatest(F.lit(10), F.least(F.lit(98), F.floor(F.round(score * 100, 6)))).cast("int")


# Relevance labels and the percentages from which they hold.
LABELS = ("очень высокая релевантность", "высокая релевантность", "возможное соответствие", "низкая релевантность")


def _label(percent: Column, *least: int) -> Column:
    out = F.lit(LABELS[-1])
    for label, low in reversed(list(zip(LABELS, least))):
        out = F.when(percent >= low, label).otherwise(out)
    return out


def server_label(percent: Column) -> Column:
    return _label(percent, 90, 75, 55)


def client_label(percent: Column) -> Column:
    return _label(percent, 85, 70, 55)


def server_guard(results: DataFrame, corpus_size: DataFrame, small: int = 2000) -> DataFrame:
    """query_id, low_confidence from results (query_id, rank, bm, vec, fusion).

    `corpus_size` is one row with n, the number of chunks.  Large corpora have
    stricter limits; without any vector score only the lexical ones are asked.
    """
    first = lambda c: F.coalesce(F.min_by(c, "rank"), F.lit(0.0))
    most = lambda c: F.coalesce(F.max(c), F.lit(0.0))
    seen = results.groupBy("query_id").agg(
        first("bm").alias("bm"), first("vec").alias("vec"), first("fusion").alias("fusion"),
        most("bm").alias("max_bm"), most("vec").alias("max_vec"), most("fusion").alias("max_fusion"),
        F.bool_or(F.col("vec").isNotNull()).alias("has_vec"),
    ).crossJoin(F.broadcast(corpus_size.select("n")))
    little = F.expr(
        "CASE WHEN has_vec THEN max_fusion < 0.35 AND ((vec < 0.25 AND bm < 0.005) OR (max_vec < 0.25 AND max_bm < 0.005)) "
        "ELSE max_bm < 0.005 AND max_fusion < 0.35 END"
    )
    much = F.expr("CASE WHEN has_vec THEN (vec < 0.32 AND bm < 0.01) OR (vec < 0.33 AND max_bm < 0.005 AND max_vec < 0.33) ELSE bm < 0.01 AND fusion < 0.35 END")
    return seen.select("query_id", F.when(F.col("n") < small, little).otherwise(much).alias("low_confidence"))


def client_guard(queries: DataFrame, results: DataFrame, corpus_size: DataFrame, small: int = 2000) -> DataFrame:
    """query_id, weak: no hits, or neither list has a convincing score."""
    seen = results.groupBy("query_id").agg(F.max(F.coalesce("vec", F.lit(0.0))).alias("v"), F.max(F.coalesce("bm", F.lit(0.0))).alias("b"))
    all_ = queries.select("query_id").join(seen, "query_id", "left").crossJoin(F.broadcast(corpus_size.select("n")))
    least = F.when(F.col("n") < small, 0.25).otherwise(0.32)
    return all_.select("query_id", (F.col("v").isNull() | ((F.greatest("v", F.lit(0.0)) < least) & (F.col("b") < 0.005))).alias("weak"))


# What a search says beside its hits.
NOTHING = "В доступной нормативной базе точного требования не найдено. Попробуйте переформулировать запрос, изменить фильтры или загрузите документ в Документы."
UNSURE = "Показаны ближайшие совпадения с низкой релевантностью — попробуйте переформулировать запрос или снять фильтры."


def messages(queries: DataFrame, hits: DataFrame, guard: DataFrame) -> DataFrame:
    """(query_id, total_found, message): what to say of no hits or of unsure ones, else null."""
    found = hits.groupBy("query_id").agg(F.count("*").alias("total_found"))
    rows = queries.select("query_id").join(found, "query_id", "left").join(guard.select("query_id", "low_confidence"), "query_id", "left")
    total = F.coalesce("total_found", F.lit(0))
    said = F.when(total == 0, NOTHING).when(F.col("low_confidence"), UNSURE)
    return rows.select("query_id", total.alias("total_found"), said.alias("message"))
