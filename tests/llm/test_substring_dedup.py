import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sedge.llm.substring_dedup import remove_repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    first = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def corpus(seed, k):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}é"[: rng.randrange(2, 5)]
    passages = [[word() for _ in range(rng.randrange(k - 2, 4 * k))] for _ in range(6)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(0, 5)):
            t += [word() for _ in range(rng.randrange(0, 30))]
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            t += p[rng.randrange(3) :] if rng.random() < 0.5 else p
        texts.append(rng.choice([" ", "\n", " \t"]).join(t))
    texts += [None, "", "   ", "a b", " ".join(["same"] * 200), " ".join(["same"] * 150), texts[3], texts[3]]
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, " ".join(WORDS.findall(r.text or ""))) for r in df.collect())


def test_matches_brute_force(spark):
    for seed, k in ((1, 50), (2, 12)):
        rows = corpus(seed, k)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert result(remove_repeats(df, k=k)) == brute(rows, k)


def test_white_space_stays_and_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(1, long), (2, f"  start\n{long}\n\nend  "), (2, f"  start\n{long}\n\nend  "), (None, long), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rk", F.lit(1)).withColumn("lang", F.lit("en"))
    got = defaultdict(list)
    for r in remove_repeats(df, keep=("lang",)).collect():
        assert r.lang == "en"
        got[r.doc_id].append((r.text, r.n_words, r.n_removed))
    assert got == {1: [(long, 60, 0)], 2: [("  start\nend  ", 62, 60)] * 2, None: [(long, 60, 0)], 3: [(None, 0, 0)]}
    assert remove_repeats(df.where("1 = 0")).count() == 0


def test_words_of_equal_polynomials_differ(spark):
    morse = "a"
    for _ in range(10):
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    line = [f"x{i}" for i in range(80)]
    rows = [(1, " ".join(line[:40] + [morse] + line[40:])), (2, " ".join(line[:40] + [other] + line[40:]))]
    assert result(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 50)


def test_hot_sources(spark, monkeypatch):
    from sedge.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT", 3)
    rows = corpus(5, 12)
    assert result(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), k=12)) == brute(rows, 12)


def test_a_span_that_is_not_its_source_stays(spark, monkeypatch):
    from sedge.llm import substring_dedup

    texts = [" ".join(f"{a}{i}" for i in range(90)) for a in "pq"]
    df = spark.createDataFrame(list(enumerate([texts[0], texts[0], texts[1]])), "doc_id long, text string")
    spans = substring_dedup.repeated_spans
    wrong = lambda docs, k: spans(docs, k).withColumn("spans", F.transform("spans", lambda s: s.withField("digest", F.lit(b"x"))))
    assert sum(r.n_removed for r in remove_repeats(df).collect()) == 90
    monkeypatch.setattr(substring_dedup, "repeated_spans", wrong)
    assert sum(r.n_removed for r in remove_repeats(df).collect()) == 0


def test_very_long_and_empty(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:40_000] + ["z"] + words[40_000:])), (3, " ".join(["again"] * 30_000)), (4, " ".join(["again", "and"] * 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(remove_repeats(df)) == brute(rows, 50)
    assert remove_repeats(df.where("1 = 0")).count() == 0
