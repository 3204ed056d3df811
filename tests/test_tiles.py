"""Vector tiles and distributed ranks against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from sedge.functions import vectors as vx
from sedge.operators import dense
from sedge.operators.ranks import exact_ranks


def test_tiles_return_the_k_nearest_of_each_query(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(400)] + [(900, None), (901, [0.0] * 6), (902, [1.0, 2.0])]
    rows += [(i + 500, v) for i, v in rows[:40]]  # ties
    df = spark.createDataFrame(rows, "id int, v array<float>").repartition(5)
    asked = df.where("id % 25 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    held = {i: np.array(v) for i, v in rows if v is not None and len(v) == 6 and any(v)}
    want = set()
    for q in (q for q in held if q % 25 == 0):
        score = {i: float(held[q] @ v / np.linalg.norm(held[q]) / np.linalg.norm(v)) for i, v in held.items()}
        best = sorted(score, key=lambda i: (-round(score[i], 6), i))[:7]
        want |= {(q, i, r + 1) for r, i in enumerate(best)}
    for tile in (1 << 9, 64 << 20):  # many tiles, one tile
        got = dense.cosine_top(asked, df, 7, tile=tile)
        assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_quantised_tiles(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)], "id long, v array<float>")
    coded = vx.quantize(df, "v")
    asked = df.where("id < 9").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    held, queries = {r.id: (r.scale, np.array(r.q, dtype=float)) for r in coded.collect()}, {r.query_id: np.array(r.qv) for r in asked.collect()}
    want = {q: sorted(held, key=lambda i: (-round(held[i][0] * float(held[i][1] @ v), 6), i))[:5] for q, v in queries.items()}
    got = {}
    for r in dense.int8_top(asked, coded, 5, tile=500).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want
    assert dense.cosine_top(asked.where("1 = 0"), df, 5).count() == 0 and dense.cosine_top(asked, df.where("1 = 0"), 5).count() == 0


def test_best_of_each_row():
    scores = np.array([[1.0, 2.0, 2.0, np.nan, 0.5], [np.nan] * 5, [3.0, 3.0, 3.0, 3.0, 3.0]])
    row, column = dense.best_of(scores, np.array([50, 40, 30, 20, 10]), 2, 6)
    assert list(zip(row.tolist(), column.tolist())) == [(0, 2), (0, 1), (2, 4), (2, 3)]


def test_ranks_of_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 9 + [None, "a", "b"]), rnd.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, score int, id int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = exact_ranks(df, ["k"], [F.desc("score"), "id"], parts=7)
        got = {r.id: r["rank"] for r in ranked.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))):
            want[r[2]] = n + 1
    assert got == want
    # the hot key's rows stand in several parts
    assert ranked.columns == ["k", "score", "id", "rank"]
    assert exact_ranks(df.where("1 = 0"), ["k"], ["id"]).count() == 0
