import random
import re

import numpy as np
from pyspark.sql import functions as F

from sedge.llm import near_dedup
from sedge.llm.near_dedup import near_duplicates

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, num, den):
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, n, size, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def corpus(seed=7):
    rng = random.Random(seed)
    texts = [*family(rng, 60, 120, 9), *family(rng, 30, 40, 4), *family(rng, 12, 9, 2), *family(rng, 6, 3, 2)]
    texts += [" ".join(f"u{rng.randrange(9000)}" for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    texts += [None, "", " \n\t", "one", "ONE", "one two", "One  two", texts[0], texts[0], texts[0].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(df):
    return {r[0]: (r[1], r[2]) for r in df.collect()}


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df, shingle=3, threshold=(85, 100))) == brute(rows, 3, 85, 100)


def test_chunked_families(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 12)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df)) == brute(rows, 5, 4, 5)


def test_null_repeated_and_empty(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (9, t), (9, "z y x w v u"), (2, "z y x w v u"), (7, None)], "doc_id long, text string")
    df = df.withColumn("n", F.lit(1)).withColumn("rep", F.lit("clash"))
    got = sorted((near_duplicates(df).select("doc_id", "component_id").collect()), key=str)
    assert [(r[0], r[1]) for r in got] == sorted([(None, None), (4, 2), (4, 2), (9, 2), (9, 2), (2, 2), (7, 7)], key=str)
    assert near_duplicates(df.where("1 = 0")).count() == 0


def slots(n, pairs, seed=11):
    """n texts of 300 words, each one of two, then copies of the last with one word changed."""
    rng = random.Random(seed)
    words = [(f"a{i}", f"b{i}") for i in range(300)]
    texts = [[rng.choice(w) for w in words] for _ in range(n)]
    for t in texts[n - pairs :]:
        copy = list(t)
        copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(copy)
    return list(enumerate(" ".join(t) for t in texts))


def brute_counts(rows, size, num, den):
    """`brute` over thousands of texts: common shingles as a product of 0/1 matrices."""
    sets = [shingles(t, size) for _, t in rows]
    code = {}
    held = [[code.setdefault(s, len(code)) for s in x] for x in sets]
    has = np.zeros((len(rows), len(code)), np.float32)
    for i, x in enumerate(held):
        has[i, x] = 1
    common = np.rint(has @ has.T).astype(np.int64)
    n = np.diag(common)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in np.argwhere(np.triu(den * common >= num * (n[:, None] + n - common), 1)).tolist():
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def test_siblings_with_far_pivots(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rows = slots(4000, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(near_duplicates(df, shingle=1)) == brute_counts(rows, 1, 4, 5)


def test_very_long_texts_and_heavy_families(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", 60_000)  # a family of three such texts is cut by its size
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    texts = [words, words[:39_000], words[1000:], words[:30_000], [f"v{i}" for i in range(40_000)]]
    rows = list(enumerate(" ".join(t) for t in texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df)) == brute(rows, 5, 4, 5)
