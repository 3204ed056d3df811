import pytest
from pyspark.sql import functions as F

from sedge.engine import Engine, capped
from sedge.functions import vectors as vx
from sedge.functions.profiles import RUSSIAN
from sedge.operators import catalog, fusion, grams, lexical
from tests.test_text import GOLDEN


def corpus(spark):
    docs = spark.createDataFrame([(0, "СН РК 3.02-43-2011", "Жилые здания", "СН РК", "active", "ru", None), (1, "СП 1", "Старый", "СП РК", "replaced", "ru", "u1")], "document_id int, number string, title string, type string, status string, language string, owner_id string")
    chunks = [(i, 0, p, page, t) for i, (p, page, t, _) in enumerate(GOLDEN)] + [(9, 1, "1.1", 1, "Ширина коридора старая норма")]
    return docs, spark.createDataFrame(chunks, "id int, document_id int, paragraph string, page int, text string")


def test_bm25_formula(spark):
    rows = spark.createDataFrame([(1, "альфа бета бета"), (2, "бета гамма"), (3, "дельта")], "id int, text string")
    counted = lexical.counted(lexical.occurrences(rows, RUSSIAN))
    sizes = lexical.lengths(counted)
    asked = spark.createDataFrame([(1, "бета бета")], "query_id int, text string")
    got = {r.id: r.score for r in lexical.bm25(lexical.query_terms(asked, RUSSIAN), lexical.postings(counted), sizes, lexical.statistics(sizes)).collect()}
    import math

    idf = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    assert got == pytest.approx({1: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)), 2: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2))})


def test_engine_search_filters_and_answers(spark, tmp_path):
    docs, chunks = corpus(spark)
    engine = Engine.index(docs, chunks, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "ширина коридора"), (2, "лестничные клетки"), (3, "нет такого слова здесь")], "query_id int, text string")
    hits = engine.search(asked)
    best = {r.query_id: r.paragraph for r in hits.where("rank = 1").collect()}
    assert best[1] == "5.8" and best[2] == "6.12" and 9 not in {r.id for r in hits.collect()}
    everything = engine.search(asked, filters={"include_expired": True})
    assert 9 in {r.id for r in everything.where("query_id = 1").collect()}
    said = {r.query_id: r for r in engine.ask(asked).collect()}
    assert said[1].is_grounded and "5.8" in said[1].answer
    assert not said[3].is_grounded and said[3].low_confidence


def test_server_fusion_micro_fixture(spark):
    lex = spark.createDataFrame([(1, 10, 2.0)], "query_id int, id int, score double")
    vec = spark.createDataFrame([(1, 20, 0.8), (1, 10, 0.6)], "query_id int, id int, score double")
    got = {r.id: r for r in fusion.server_fusion(lex, vec).collect()}
    assert got[10].rrf == pytest.approx(0.332522, abs=1e-6) and got[20].rrf == pytest.approx(0.216393, abs=1e-6)
    assert (got[10].percent, got[20].percent) == (88, 80)


def test_rrf_ignores_the_scale_of_scores(spark):
    lex = spark.createDataFrame([(1, i, 5.0 - i) for i in range(4)], "query_id int, id int, score double").withColumn("variant", F.lit(0))
    vec = spark.createDataFrame([(1, i, i / 10) for i in range(4)], "query_id int, id int, score double")
    a = fusion.client_fusion(lex, vec).orderBy("rank").select("id", "rrf").collect()
    b = fusion.client_fusion(lex.withColumn("score", F.col("score") * 100), vec).orderBy("rank").select("id", "rrf").collect()
    assert a == b


def test_labels(spark):
    df = spark.createDataFrame([(0.899,), (0.9,), (0.05,), (1.0,)], "s double").select(fusion.server_percent(F.col("s")).alias("p"))
    assert [(r.p, r.l) for r in df.withColumn("l", fusion.server_label(F.col("p"))).collect()] == [
        (89, fusion.LABELS[1]), (90, fusion.LABELS[0]), (10, fusion.LABELS[3]), (98, fusion.LABELS[0])
    ]


def test_quantisation(spark):
    df = spark.createDataFrame([(1, [0.6, -0.8, 0.0]), (2, [0.0, 0.0, 0.0])], "id int, v array<double>")
    got = {r.id: r for r in vx.quantize(df, "v", 3).collect()}
    assert got[1].scale == pytest.approx(0.8 / 127) and got[1].q == [95, -127, 0]
    assert got[2].scale == 1.0 and got[2].q == [0, 0, 0]
    with pytest.raises(Exception, match="vector length"):
        vx.quantize(df, "v", 4).collect()


def test_tenancy_has_three_states(spark):
    docs = spark.createDataFrame([(1, "active", None), (2, "active", "x"), (3, "active", "y"), (4, "expired", None)], "document_id int, status string, owner_id string")
    seen = lambda f: sorted(r[0] for r in docs.where(catalog.visible(f)).select("document_id").collect())
    assert seen({}) == [1, 2, 3] and seen({"owner_id": None}) == [1] and seen({"owner_id": "x"}) == [1, 2] and seen({"include_expired": True}) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        catalog.visible({"year": 2020})


def test_cascade_takes_the_first_list_with_an_answer(spark):
    asked = [(1, "abcd", ["abcd"]), (2, "zebra x", ["zebra"]), (3, "quicks silvers", ["quicks", "silvers"]), (4, "quicks silvers", ["quicks"]), (5, "ab", ["ab"]), (6, "zzzzzz", [])]
    q = spark.createDataFrame(asked, "query_id int, text string, words array<string>")
    rows = spark.createDataFrame([(7, "ZEBRAS run"), (8, "quick silver"), (9, None)], "id int, text string")
    scored = lambda *ids: spark.createDataFrame([(i, 7, 0.9) for i in ids], "query_id int, id int, score double")
    got = {(r.query_id, r.id): (r.source, r.score) for r in grams.cascade(scored(1), rows, q, scored(4)).collect()}
    assert got == {(1, 7): ("fts", 0.9), (2, 7): ("ilike", 0.5), (3, 8): ("trigram", pytest.approx(0.8 * 11 / 17))}


def test_deep_search_needs_all_terms_of_a_variant_and_averages_vectors(spark, tmp_path):
    docs, chunks = corpus(spark)
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i else [0.6, 0.8]) for i in (0, 1, 2, 3)], "id int, v array<double>")
    engine = Engine.index(docs, chunks, str(tmp_path / "index"), vectors)
    stored = {r.id: r.v for r in Engine.open(spark, docs, str(tmp_path / "index")).vectors.collect()}
    assert stored[0] == pytest.approx([0.6, 0.8], abs=0.01) and stored[1] == pytest.approx([1.0, 0.0])
    asked = spark.createDataFrame([(1, "ширина коридора"), (2, "ккоридор"), (3, "широкий коридор")], "query_id int, text string")
    qv = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id int, qv array<double>")
    deep = engine.search(asked, qv, "deep").collect()
    first = next(r for r in deep if r.query_id == 1 and r.id == 0)
    assert first.source == "fts" and first.vec == pytest.approx(1.4 / 2**0.5, abs=1e-6)
    assert {r.source for r in deep if r.query_id == 3} == {"ilike"} and any(r.query_id == 3 for r in deep)
    said = {r.query_id: r.message for r in engine.ask(asked).collect()}
    assert said[1] is None or said[1] == fusion.UNSURE


def test_index_grows_without_changing_old_postings(spark):
    _, chunks = corpus(spark)
    terms = lambda df: {(r.term, r.id): r.tf for r in lexical.postings(lexical.counted(lexical.occurrences(df, RUSSIAN))).collect()}
    small, large = terms(chunks.where("id < 9")), terms(chunks)
    assert all(large[k] == v for k, v in small.items())


def test_caps_of_hits():
    assert [capped(None), capped(None, "deep"), capped(None, "deep", client=True), capped(5), capped(500), capped(0)] == [10, 10, 20, 5, 20, 1]
