import random
import re

from pyspark.sql import functions as F

from sedge.functions.automaton import Automaton, highlight_each, highlighted, variants_of
from sedge.operators import expansion


def test_all_places_of_all_patterns():
    rnd = random.Random(1)
    for _ in range(300):
        patterns = list({"".join(rnd.choices("ab", k=rnd.randrange(1, 5))) for _ in range(6)})
        text = "".join(rnd.choices("abc", k=40))
        want = {(i + len(p), patterns.index(p)) for p in patterns for i in range(len(text)) if text.startswith(p, i)}
        automaton = Automaton(patterns)
        assert set(automaton.matches(text)) == want
        longest = "|".join(sorted(patterns, key=len, reverse=True))
        assert automaton.spans(text) == [m.span() for m in re.finditer(longest, text)]
    assert list(Automaton([]).matches("abc")) == [] and Automaton(["", "b"]).spans("abc") == [(1, 2)]


def test_ten_thousand_keys(spark):
    """Each variant as by trying all keys one after another."""
    rnd = random.Random(2)
    synonyms = {f"key{i}x": [f"alt{i}", f"other{i}", "unused"] for i in range(10_000)}
    texts = [" ".join(rnd.choices([*synonyms, "plain"], k=rnd.randrange(0, 6))) for _ in range(50)] + ["", "nothing"]

    def plain(text, first, limit):
        tried = [text]
        for key, alternatives in synonyms.items():
            if key in text:
                tried += [text.replace(key, s, 1 if first else -1) for s in alternatives[:2]]
        return list(dict.fromkeys(tried))[:limit]

    for first, limit in ((False, 3), (True, 7)):
        expand = variants_of(synonyms, first, limit)
        assert [expand(t) for t in texts] == [plain(t, first, limit) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {}
    for r in expansion.expand(df, synonyms).orderBy("pos").collect():
        got.setdefault(r.query_id, []).append(r.variant)
    assert got == {i: plain(t, False, 3) for i, t in enumerate(texts)}


def test_each_row_has_its_own_tokens(spark):
    rows = [("Ёлка и елка", ["елка"]), ("The other theme", ["the", "them"]), ("x", None), (None, ["x"]), ("a.b a+b", ["a.b"]), ("same", []), ("İstanbul is", ["is"])]
    df = spark.createDataFrame(rows, "text string, tokens array<string>").select(highlight_each(F.col("text"), F.col("tokens")).alias("m"))
    assert [r.m for r in df.collect()] == [
        "<mark>Ёлка</mark> и <mark>елка</mark>", "<mark>The</mark> o<mark>the</mark>r <mark>them</mark>e", "x", None, "<mark>a.b</mark> a+b", "same", "İstanbul <mark>is</mark>",
    ]
    assert highlighted("", ["a"]) == ""
