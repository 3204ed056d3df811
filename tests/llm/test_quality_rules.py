import re

from pyspark.sql import functions as F

from sedge.llm.quality_rules import quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORDS.findall(text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = {g for g in wins if wins.count(g) > 1}
    hit = {i + k for i, g in enumerate(wins) if g in many for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_and_base_rule(spark):
    long = " ".join(f"w{i}" for i in range(30))
    texts = [None, "", "a b", long, long + "\n" + long, "\n".join(["x y z"] * 9), " ".join(["r"] * 40), "é# $ 😀 <b>|\n\n \n x \n x", " ".join(f"w{i % 8}" for i in range(17)) + " " + long, "a b c d e f g h"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("q_row", F.lit(1)).withColumn("id", F.lit(2))
    for r in quality_rules(df).collect():
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)


def test_frequent_lines_deplete(spark):
    body = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    boiler = " ".join(f"b{k}" for k in range(40))
    rows = [(i, f"{boiler.upper()} \n{body(i, 30 if i % 2 else 10)}", "h") for i in range(30)]
    rows += [(100 + i, f"{boiler}\n{body(i, 10)}", None) for i in range(5)]  # too few for the limit
    rows += [(200, f"{boiler}\n{boiler}\n{body(1, 25)}", "h"), (200, f"{boiler}\n{boiler}\n{body(1, 25)}", "h"), (None, body(3, 30), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.n_frequent_words, r.kept) for r in quality_rules(df).collect()}
    want = {(i, 40, bool(i % 2)) for i in range(30)} | {(100 + i, 0, True) for i in range(5)} | {(None, 0, True)}
    assert {x for x in got if x[0] != 200} == want
    assert {x[1] for x in got if x[0] == 200} == {80} and quality_rules(df).count() == len(rows)
    assert quality_rules(df.where("1 = 0")).count() == 0


def test_very_long_and_clashing(spark):
    text = "\n".join(" ".join(f"w{i * 9 + k}" for k in range(9)) for i in range(12_000))
    df = spark.createDataFrame([(1, text, "h"), (2, text + "\nw0 w1", "h")], "doc_id long, text string, source string")
    for name in ("host", "line", "pos", "n", "x", "docs", "kept", "n_words"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r.doc_id: (r.n_words, r.n_dup_lines, r.n_repeat_words, r.kept) for r in quality_rules(df).collect()}
    assert got == {1: (108_000, 0, 0, True), 2: (108_002, 0, 0, True)}
