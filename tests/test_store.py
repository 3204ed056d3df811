import json

import pytest
from pyspark.sql import functions as F

from sedge.operators import catalog, grams, lexical
from sedge.sources import artifacts, collected, providers
from sedge.sources.store import Store


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "document_id int, owner_id string, checksum string")


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "document_id int, id int, text string")


def test_store_inserts_once_and_reindexes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    first = store.insert_new(docs_of(spark, [(1, None, "a"), (2, "u", "a"), (3, None, "a")]), chunks_of(spark, [(1, 10, "x"), (2, 20, "y"), (3, 30, "z")]))
    assert first.count() == 2
    again = store.insert_new(docs_of(spark, [(4, None, "a"), (5, "u", "b")]), chunks_of(spark, [(4, 40, "x"), (5, 50, "w")]))
    assert [r.document_id for r in again.collect()] == [5]
    kept = {r.document_id for r in store.table("documents").collect()}
    assert len(kept) == 3 and {r.document_id for r in store.table("chunks").collect()} == kept
    store.reindex(chunks_of(spark, [(5, 51, "new"), (5, 52, "new")]))
    assert sorted(r.id for r in store.table("chunks").where("document_id = 5").collect()) == [51, 52]
    assert store.table("chunks").where("document_id <> 5").count() == 2
    assert store.point(2).count() == 0 and store.point(2, "u").count() == 1


def test_json_index(spark, tmp_path):
    put = lambda name, value: (tmp_path / f"{name}.json").write_text(json.dumps(value, ensure_ascii=False))
    put("docs", [{"id": "0", "number": "n", "title": "t", "status": "active", "pages": 3, "file": "f"}])
    put("chunks", [{"i": 0, "d": 0, "p": "5.8", "pg": 42, "t": "text", "ty": "paragraph"}])
    put("bm25", {"k1": 1.2, "b": 0.75, "avgdl": 2.5, "len": [2, 3], "postings": {"ширин": [[0, 2], [1, 1]], "марш": [[1, 2]]}})
    put("synonyms", {"я": ["a"], "б": ["c", "d"]})
    got = artifacts.read_json_index(spark, str(tmp_path))
    assert sorted(map(tuple, got["postings"].collect())) == [("марш", 1, 2), ("ширин", 0, 2), ("ширин", 1, 1)]
    assert [r.key for r in got["synonyms"].orderBy("ord").collect()] == ["я", "б"]
    terms = spark.createDataFrame([(1, "марш")], "query_id int, term string")
    assert [r.id for r in lexical.bm25(terms, got["postings"], got["lengths"], got["stats"].select("n", "avgdl")).collect()] == [1]


class Lengths:
    dim = 2

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


class Bad(Lengths):
    dim = 3


class Echo:
    def generate(self, prompts):
        return [p.upper() for p in prompts]


class Lines:
    def pages(self, content):
        return content.decode().split("\f")


def test_providers(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Ab "), (2, "ab"), (3, None)], "id int, text string")
    got = {r.id: r.embedding for r in providers.embed(texts, Lengths()).collect()}
    assert got == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: None}
    with pytest.raises(Exception, match="not of length 3"):
        providers.embed(texts, Bad()).collect()
    asked = spark.createDataFrame([(1, "q")], "query_id int, text string")
    context = spark.createDataFrame([(1, "c")], "query_id int, context string")
    out = providers.generate(providers.prompts(asked, context, "{query} from {context}"), Echo())
    assert out.first().output == "Q FROM C"
    (tmp_path / "b.pdf").write_text("one\ftwo")
    (tmp_path / "a.pdf").write_text("three")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(tmp_path))
    assert sorted((r.page, r.text) for r in providers.file_pages(files, Lines()).collect()) == [(1, "one"), (1, "three"), (2, "two")]
    assert [r.path[-5:] for r in collected.pages_from_binary(files).orderBy("ordinal").collect()] == ["a.pdf", "b.pdf"]


def test_sources_by_id_and_shown_hits(spark):
    chunks = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "id int, text string")
    asked = spark.createDataFrame([(1, [5, 99, 3, 1, 0, 2])], "query_id int, ids array<int>")
    assert [r.id for r in catalog.by_ids(chunks, asked).collect()] == [5, 3, 1, 0]
    hits = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id int, rank int")
    said = spark.createDataFrame([(1, True), (2, False)], "query_id int, is_grounded boolean")
    assert sorted(map(tuple, catalog.without_answered(hits, said).collect())) == [(1, 2), (2, 1)]
    words = spark.createDataFrame([("a bcd efg hij klm nop", ["xyz bcd q", "uvw abc"])], "t string, v array<string>")
    assert words.select(grams.fallback_words(F.col("t"), F.col("v"))).first()[0] == ["bcd", "efg", "hij", "klm", "xyz", "uvw"]
    asked = spark.createDataFrame([(1, ["T3", "_"])], "query_id int, words array<string>")
    assert [r.id for r in grams.contains_search(chunks, asked).collect()] == [3]


def test_grounded_answers_are_asked_for_twice_at_most(spark):
    class Model:
        def generate(self, prompts):
            said = lambda p: "verbatim" if "good" in p or ("slow" in p and providers.STRICTER in p) else "invented"
            return ['{"answer": "x", "quote": "' + said(p) + '"}' for p in prompts]

    asked = spark.createDataFrame([(1, "good"), (2, "slow"), (3, "bad")], "query_id int, text string")
    contexts = asked.selectExpr("query_id", "'A Verbatim  context' AS context")
    got = {r.query_id: (r.quote, r.is_grounded, r.retried) for r in providers.generate_grounded(asked, contexts, Model()).collect()}
    assert got == {1: ("verbatim", True, False), 2: ("verbatim", True, True), 3: ("invented", False, True)}


def test_fuzzy_pairs_equal_the_slow_rule(spark):
    import random

    from sedge.operators import answers

    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    texts = [[rng.choice(words) for _ in range(rng.randrange(0, 60))] for _ in range(40)]
    quotes = []
    for i in range(60):
        source, n = rng.choice([t for t in texts if len(t) > 30]), rng.randrange(1, 28)
        at = rng.randrange(0, len(source) - n + 1)
        quote = source[at : at + n]
        for k in rng.sample(range(n), min(n, rng.randrange(0, 5))):
            quote[k] = "changed"
        quotes.append(" ".join(quote)[rng.randrange(0, 2) :])
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, text string")
    c = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "context_id int, text string")
    want = {}
    for i, quote in enumerate(quotes):
        for j, text in enumerate(texts):
            if len(quote.strip()) < 10:
                continue
            w, squeezed = quote.split(), " ".join(text)
            exact = " ".join(w) in squeezed
            fuzzy = len(w) >= 5 and any(sum(a == b for a, b in zip(w, text[k:])) / len(w) >= 0.85 for k in range(len(text) - len(w) + 1))
            if exact or fuzzy:
                want[i, j] = (exact, fuzzy)
    got = {(r.quote_id, r.context_id): (r.exact, r.fuzzy) for r in answers.grounded_pairs(q, c).collect()}
    assert got == want and any(f and not e for e, f in want.values()) and any(e and not f for e, f in want.values())
