import pytest
from pyspark.sql import functions as F

from sedge.functions import text as tx
from sedge.functions.profiles import LATIN, RUSSIAN, SYNONYMS
from sedge.operators import expansion


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# Clauses of the demo corpus (clause, page, text) and their length in tokens.
GOLDEN = [
    ("5.8", 42, "Ширина коридоров в жилых зданиях должна быть не менее 1,4 м при длине коридора до 10 м и не менее 1,6 м при большей длине. Ширина коридоров, ведущих к эвакуационным выходам, должна быть не менее 1,2 м.", 19),
    ("5.9", 42, "Ширина эвакуационных путей и выходов должна обеспечивать беспрепятственное движение людей. Минимальная ширина эвакуационного выхода из помещения — 0,9 м, из здания — 1,2 м. Высота эвакуационных путей в свету — не менее 2,0 м.", 20),
    ("6.12", 55, "Лестничные клетки в жилых зданиях должны иметь ширину марша не менее 1,05 м. Ширина лестничной площадки — не менее ширины марша. Уклон марша — не более 1:1,5.", 18),
    ("7.3", 60, "Минимальная высота жилых помещений от пола до потолка — 2,5 м, в климатических районах с повышенной влажностью — 2,7 м. Высота коридоров и холлов — не менее 2,1 м.", 14),
]


def test_token_lengths_of_golden_clauses(spark):
    df = spark.createDataFrame([(t, n) for _, _, t, n in GOLDEN], "t string, n int")
    for got, want in df.select(F.size(tx.tokenize(F.col("t"), RUSSIAN)), "n").collect():
        assert got == want


def test_tokens_keep_three_characters(spark):
    assert one(spark, tx.tokenize(F.lit("Ширина коридора, Ёлки 42 я running ed"), LATIN)) == ["42", "runn", "ed"]
    assert one(spark, tx.tokenize(F.lit("ширина коридора"), RUSSIAN)) == ["ширин", "коридор"]
    assert one(spark, tx.tokenize(F.lit(None).cast("string"), RUSSIAN)) == []


def test_normalised_queries(spark):
    assert one(spark, tx.normalize_query(F.lit("  Ёлка — «Ұзын»  пл.-1_a "))) == "елка ұзын пл -1_a"
    assert one(spark, tx.normalize_query_client(F.lit("Ұзын ёлка"))) == "зын елка"


def test_trigram_similarity(spark):
    got = one(spark, tx.jaccard(tx.trigrams(F.lit("word")), tx.trigrams(F.lit("two words"))))
    assert got == pytest.approx(0.363636, abs=1e-6)


def test_expansion_variants(spark):
    asked = spark.createDataFrame([(1, "ширина коридора"), (2, "окно окно")], "query_id int, text string")
    rows = lambda **k: [(r.query_id, r.variant) for r in expansion.expand(asked, SYNONYMS, **k).orderBy("query_id", "pos").collect()]
    server = rows()
    assert [v for i, v in server if i == 1] == ["ширина коридора", "ширина прохода", "ширина проходной коридора"]
    assert [v for i, v in server if i == 2] == ["окно окно", "оконный проём оконный проём", "остекление остекление"]
    assert [v for i, v in rows(first_only=True) if i == 2][1] == "оконный проём окно"


def test_small_functions(spark):
    assert one(spark, tx.highlight(F.lit("Ёлка и елка"), ["елка"])) == "<mark>Ёлка</mark> и <mark>елка</mark>"
    assert one(spark, tx.status_from_text(F.lit("Утратил силу, заменен на"))) == "replaced"
    assert one(spark, tx.document_type(F.lit("сп рк 3.02"))) == "СП РК"
    assert one(spark, tx.upload_name(F.lit("a b//c.pdf"))) == "a_b_c.pdf"
    assert one(spark, tx.highlight_tokens(F.lit("Противо-дымная защита защита"))) == ["противо-дымная", "противо", "дымная", "защита"]
    assert one(spark, tx.without_fences(F.lit('<think>x</think>```json\n{"a": [1,],}\n```'))) == '{"a": [1]}'
    assert one(spark, tx.join_url(F.lit("https://a.kz/x/y"), F.lit("/rus/docs/1"))) == "https://a.kz/rus/docs/1"
