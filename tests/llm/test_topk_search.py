import math
import random

from pyspark.sql import functions as F

from sedge.llm import topk_search
from sedge.llm.topk_search import exact_top_k, integer_vectors


def brute(rows, k=10):
    vecs = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(vecs):
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def run(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("vec", F.lit(0))
    ints = integer_vectors(df, "vec_id", "embedding", 1024)
    return sorted(tuple(r) for r in exact_top_k(ints, ints.where("id % 100 = 0"), k).collect())


def test_matches_brute_force_with_pruning(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) / (1 + d) for d in range(40)]) for i in range(900)]
    rows += [(1000 + i, list(rows[i % 7][1])) for i in range(60)]  # ties
    rows = [(i, [float(x) for x in map(lambda y: round(y, 3), v)]) for i, v in rows]
    monkeypatch.setattr(topk_search, "TILE", 4000)
    monkeypatch.setattr(topk_search, "BLOCK", 160)
    monkeypatch.setattr(topk_search, "UNIT", 2)  # several copies of a tile
    import numpy as np

    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == sorted(brute(exact))


def test_odd_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (100, [1.0, 2.0]), (5, [0.5, -0.5]), (6, [1.0]), (200, [2.0]), (300, []), (None, [1.0, 1.0]), (0, [1.0, 2.0])]
    want = sorted(brute([(i, v) for i, v in rows if i is not None]))
    assert run(spark, rows) == want and {r[0] for r in want} == {0, 100, 200}
    empty = integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding", 1024)
    assert exact_top_k(empty, empty).collect() == []
    assert run(spark, [(0, [1.0])]) == [] and run(spark, [(1, None)]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 1.0]), (2, [1e6, 1.001]), (3, [-1e6, 5.0])]
    import numpy as np

    assert run(spark, rows) == sorted(brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows]))
