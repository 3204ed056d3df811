import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from sedge.llm import mixing
from sedge.llm.mixing import leaf_budgets, mix_sources


def fill(caps, weights, budget):
    """Exact water filling: shares, by fixing what is saturated until nothing is."""
    full, names = {}, set(caps)
    while True:
        rest, open_ = budget - sum(full.values()), names - set(full)
        total = sum(weights[n] for n in open_)
        over = [n for n in open_ if weights[n] and Fraction(caps[n], weights[n]) <= Fraction(rest, total)]
        if not over:
            return {n: full.get(n, rest * weights[n] // total if n in open_ and total else 0) for n in names}
        full |= {n: caps[n] for n in over}


def test_shortages_go_to_siblings_first(spark):
    rng = random.Random(8)
    rows = [(d, x, rng.randrange(0, 50)) for d in "abc" for x in "pqrs"]
    leaves = spark.createDataFrame([(d, x, t, 1) for d, x, t in rows], "d string, x string, tokens long, rows_ long")
    weights = {"d": {"a": 5, "b": 2, "c": 0}, "x": {"p": 3, "s": 0}}
    for target in (0, 7, 60, 150, 10**6):
        got = {(r.d, r.x): r.share for r in leaf_budgets(leaves, ["d", "x"], weights, target, 2).collect()}
        caps = {d: sum(2 * t for a, _, t in rows if a == d) for d in "abc"}
        tops = fill(caps, {d: weights["d"].get(d, 1) for d in "abc"}, target)
        want = {(d, x): s for d in "abc" for x, s in fill({x: 2 * t for a, x, t in rows if a == d}, {x: weights["x"].get(x, 1) for x in "pqrs"}, tops[d]).items()}
        assert got == want


def test_prefixes_of_seeded_epochs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(0, 9), rng.choice(["x", "x", "x", "y", None])) for i in range(150)] + [(None, "a b", "x"), (7, "c d", "y"), (200, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("epochs", F.lit("clash")).withColumn("mix_cut", F.lit(1))
    out = mix_sources(df, {"s": F.col("source")}, {"s": {"x": 3}}, target_share=(3, 2)).collect()
    assert len(out) == len(rows)
    tokens = lambda t: len((t or "").split())
    held = {s: sum(tokens(t) for _, t, x in rows if (x or "") == s) for s in ("x", "y", "")}
    shares = fill({s: 4 * n for s, n in held.items()}, {"x": 3, "y": 1, "": 1}, sum(held.values()) * 3 // 2)
    for s in held:
        epochs, left = divmod(shares[s], held[s])
        place = lambda i: hashlib.md5(f"17:{epochs}:{'' if i is None else i}".encode()).hexdigest()  # noqa: E731,B023
        own = sorted((place(i), tokens(t)) for i, t, x in rows if (x or "") == s)
        cut, total = "", 0
        for key in sorted({k for k, _ in own}):
            total += sum(n for k, n in own if k == key)
            cut = key if total <= left else cut
            if total > left:
                break
        for r in out:
            if (r.source or "") == s:
                assert r.mix_copies == epochs + (left > 0 and place(r.doc_id) <= cut), (s, r)
    assert mix_sources(df.where("1 = 0"), {"s": F.col("source")}).count() == 0
