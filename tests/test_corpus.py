import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sedge.operators import answers, chunking, usage
from sedge.plans import catalogue
from sedge.sources import artifacts, collected
from sedge.streaming import jobs


def chunks_of(spark, *pages):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages)], "doc_id int, page int, text string")
    return [(r.page, r.chapter, r.paragraph, r.type, r.text) for r in chunking.chunk(df).orderBy("ordinal").collect()]


def test_chunks_of_a_code(spark):
    long = "слово " * 20
    got = chunks_of(
        spark,
        f"Глава 1 Общие\n5.1 {long}\nпродолжение\nТаблица 3 Нормы\nстроки таблицы здесь и далее ещё\nГЛАВА 2 Иное\n5.2. Короткий пункт нормы\nхвост",
        f"обычный текст без номера, длинный\n5.2 {long}\n5.2 ещё немного",
    )
    long = long.strip()
    assert got == [
        (0, "Глава 1 Общие", "5.1", "paragraph", f"5.1 {long} продолжение"),
        (0, "Глава 1 Общие", "5.1", "table", "Таблица 3 Нормы"),
        (0, "Глава 1 Общие", None, "paragraph", "строки таблицы здесь и далее ещё"),
        (0, "ГЛАВА 2 Иное", "5.2", "paragraph", "5.2. Короткий пункт нормы хвост"),
        (1, "ГЛАВА 2 Иное", None, "paragraph", "обычный текст без номера, длинный"),
        (1, "ГЛАВА 2 Иное", "5.2", "paragraph", f"5.2 {long} 5.2 ещё немного"),
    ]


def test_noise_limits(spark):
    assert chunks_of(spark, "x" * 24) == [] and len(chunks_of(spark, "x" * 25)) == 1
    assert chunks_of(spark, "5.1 " + "x" * 10) == [] and len(chunks_of(spark, "5.1 " + "x" * 11)) == 1
    assert len(chunks_of(spark, "Таблица 1")) == 1


def test_windows_cover_the_text():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["ab", " ", ". ", "слово", "; "]) for _ in range(rng.randrange(10, 4000))).strip()
        parts = chunking.split_long(text, 300, 60)
        assert all(len(p) <= 300 for p in parts) and text.startswith(parts[0]) and text.endswith(parts[-1])
        at = 0
        for p in parts:
            at = text.index(p, max(0, at - 70))
            assert p in text
            at += len(p)


def test_grounding(spark):
    quote = "один два три четыре пять шесть семь"
    rows = [("короткий", "короткий", False), ("ёлка стоит в лесу", "Елка  стоит в лесу.", True), (quote, quote.replace("три", "ТРЁХ"), True), ("один два три четыре пять", "один два трёх четыре пять", False), (None, "x", False)]
    df = spark.createDataFrame(rows, "q string, c string, want boolean")
    for got, want in df.select(answers.grounded(F.col("q"), F.col("c")), "want").collect():
        assert got == want


def test_answers_are_checked(spark):
    hits = spark.createDataFrame([(1, 1, "5.8", 42, "ширина коридора не менее 1,4 м при длине до 10 м"), (1, 2, "5.9", 43, "иной текст о высоте помещений")], "query_id int, rank int, paragraph string, page int, text string")
    said = spark.createDataFrame([(1, "Не менее 1,4 м", "9.9", 9000, "ширина коридора совсем другая норма")], "query_id int, answer string, paragraph string, page int, quote string")
    got = answers.checked_answers(said, hits).first()
    assert (got.paragraph, got.page, got.quote_was_grounded, got.quote_repaired) == ("5.8", 42, False, True)
    assert got.quote.startswith("ширина коридора не менее")


def test_balanced_json():
    assert answers.first_object('x {"a": "}\\"{", "b": {"c": 1}} {2}') == '{"a": "}\\"{", "b": {"c": 1}}'
    assert answers.first_object("no") is None and answers.first_object(None) is None and answers.first_object("{ open") is None


def test_repair_and_markdown(spark):
    df = spark.createDataFrame([('<think>{</think>```json\n{"answer": "да", "p": [1,],}```',), ("просто текст",)], "text string")
    assert [r.answer for r in answers.repaired_output(df).collect()] == ["да", "просто текст"]
    hits = spark.createDataFrame([(1, 1, "СН 1", "x" * 600)], "query_id int, rank int, number string, text string")
    said = spark.createDataFrame([(1, "вопрос", "ответ")], "query_id int, query string, answer string")
    out = answers.markdown(said, hits).first().markdown
    assert out.startswith("# вопрос\n\nответ\n\n### 1. СН 1\n\n> xxx") and out.endswith("x…") and len(out) < 560


def test_credits(spark):
    rows = [("a", i, dt.datetime(2024, 1, 1, 0, i)) for i in range(4)] + [("a", 9, dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "subject string, request_id long, ts timestamp")
    got = {r.request_id: (r.accepted, r.used) for r in usage.daily_credits(df).collect()}
    assert got == {0: (True, 10), 1: (True, 20), 2: (True, 30), 3: (False, 30), 9: (True, 10)}


def test_collected_links(spark):
    html = "<a href='/rus/docs/1.pdf'>СН РК 3.02-43-2011 нормы</a><a href='/rus/docs/2'><b>Утратил силу СНиП 2.08</b></a><a href='/rus/docs/2'>повтор ссылки</a><a href='/x'>мимо ссылка</a>"
    pages = spark.createDataFrame([("https://a.kz/list", html)], "url string, html string")
    got = [(r.target, r.number, r.status) for r in collected.listing(pages, "/rus/docs/").orderBy("pos").collect()]
    assert got == [("https://a.kz/rus/docs/1.pdf", "СН РК 3.02-43-2011", "active"), ("https://a.kz/rus/docs/2", "СНиП 2.08", "expired")]
    assert collected.pdf_link(pages).first().pdf == "https://a.kz/rus/docs/1.pdf"


def test_lines_are_judged_by_what_they_say_not_by_their_number(spark, tmp_path):
    """The SQL of paragraph_islands took a line's kind from its number: it erred on clauses, chapters and empty lines of the text itself."""
    rows = ["a", "b", "3.14 is a number\u00a0", "", "", "Раздел 2 " + "x" * 300, "c\x0c", "d", "1.2", "2.5.1) e", "f", "\u2003", "таблица 4 of the text", "g", "h", "Приложение К", "", "i", "k", "4.1.\tl", "m", "\t", "n"]
    docs = [(1, "\n".join(rows)), (2, "\n".join(reversed(rows))), (3, ""), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["paragraph_islands"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()['paragraph_islands']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and any(r.chapter and r.chapter.startswith("Раздел 2 x") for r in got.collect())


def test_vector_files_round_trip(spark):
    z = spark.createDataFrame([(i, 0.5 + i, [i % 100, -i % 100, 3]) for i in range(500)], "id long, scale float, q array<tinyint>")
    files = artifacts.encode_shards(z, 128)
    assert files.count() > 1
    assert sorted(artifacts.decode_shards(files).collect()) == sorted(z.collect())
    with pytest.raises(Exception, match="not a vector file"):
        artifacts.decode_shards(files.withColumn("content", F.concat(F.lit("x").cast("binary"), "content"))).collect()


def test_ingest_takes_every_new_document_once(spark, tmp_path):
    schema = "id long, number string, text string"
    make = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    make("a", [(1, "n1", "x" * 6000), (2, "n2", "short"), (3, "n3", "x" * 6000), (6, "n1", "z" * 6000), (7, "n7", "x" * 6000), (8, "n8", "x" * 6000), (9, "n9", "x" * 6000)])
    job = jobs.PollIngest(str(tmp_path / "job"), schema, ["number"], most=2)

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        job.stream(stream, str(tmp_path / "check")).awaitTermination()
        return sorted(r.id for r in job.documents(spark).collect())

    assert run() == [1, 3]
    make("b", [(4, "n3", "y" * 6000), (5, "n5", "y" * 6000)])
    assert run() == [1, 3, 5, 7]  # what didn't fit into the first poll is not lost
    assert job.poll(spark, "s000000001", spark.createDataFrame([(4, "n3", "y" * 6000), (5, "n5", "y" * 6000)], schema)) == 2  # a poll that runs again changes nothing
    assert job.drain(spark) == 1 and job.drain(spark) == 0
    assert sorted(r.id for r in job.documents(spark).collect()) == [1, 3, 5, 7, 8, 9]
    log = {r.poll: (r.status, r.found, r.new) for r in job.log(spark).collect()}
    assert [log[k] for k in sorted(log)] == [("success", 0, 2), ("no_changes", 0, 0), ("no_changes", 0, 0), ("success", 7, 2), ("success", 2, 2)]


def test_draining_takes_one_run_for_any_number_of_polls(spark, tmp_path):
    """Polls were one after another over all that waits: thirty of them took as many passes."""
    schema = "id long, number string, text string"
    rows = [(i, None if i == 40 else f"n{i % 90}", "x" * 10) for i in range(100)] + [(7, "other", "y" * 10), (None, "none", "z" * 10)]
    job = jobs.PollIngest(str(tmp_path / "job"), schema, ["number"], most=3, least_bytes=5)
    assert job.poll(spark, "s000000000", spark.createDataFrame(rows, schema).repartition(4)) == 3
    runs, poll = [], job.poll
    job.poll = lambda *a: runs.append(a) or poll(*a)
    assert job.drain(spark) == 30 and not runs
    got = {(r.id, r.number): r.poll for r in job.documents(spark).collect()}
    want = sorted({(i, n) for i, n, _ in rows if i is not None and i < 90}, key=lambda r: (r[0], r[1] or ""))
    assert got == {r: f"d{k // 3 - 1:09d}" if k > 2 else "s000000000" for k, r in enumerate(want)}
    log = sorted((r.poll, r.status, r.new) for r in job.log(spark).collect())
    assert log[:30] == [(f"d{k:09d}", "success", 3 if k < 29 else 1) for k in range(30)] and log[30:] == [("d000000030", "no_changes", 0), ("s000000000", "success", 3)]
    assert job.drain(spark) == 0


def test_credit_windows_go_on_after_a_restart(spark, tmp_path):
    """Costs differ, a window ends after 24 hours, and state comes back from the checkpoint."""
    schema = "subject string, request_id long, ts timestamp, cost long"
    at = lambda hour: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)
    make = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    make("a", [("a", 2, at(1), 20), ("a", 1, at(0), 15), ("b", 3, at(2), 31), ("b", 4, at(3), 30)])

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        with jobs.state_store(spark):
            out = jobs.run_to_end(jobs.credit_windows(stream, 30), str(tmp_path / "out"), str(tmp_path / "c"), "append")
        return {r.request_id: (r.accepted, r.used) for r in out.collect()}

    assert run() == {1: (True, 15), 2: (False, 15), 3: (False, 0), 4: (True, 30)}
    make("b", [("a", 5, at(23), 15), ("a", 6, at(24), 30), ("b", 7, at(25), 1), ("b", 8, at(26), 1)])
    assert {k: v for k, v in run().items() if k > 4} == {5: (True, 30), 6: (True, 30), 7: (False, 30), 8: (True, 1)}


def test_stream_quota_folds_costs(spark, tmp_path):
    rows = [("a", 1, 20), ("a", 2, 20), ("a", 3, 10), ("b", 4, 30), ("b", 5, 1)]
    spark.createDataFrame(rows, "subject string, request_id long, cost long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("subject string, request_id long, cost long").parquet(str(tmp_path / "in*"))
    jobs.quota(stream, 30).writeStream.format("memory").queryName("quota_test").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r.request_id: (r.accepted, r.used) for r in spark.table("quota_test").collect()}
    assert got == {1: (True, 20), 2: (False, 20), 3: (True, 30), 4: (True, 30), 5: (False, 30)}


def folded(parts):
    """Chunks by the rule itself, one after another."""
    kept = []
    for page, paragraph, kind, text in parts:
        last = kept[-1] if kept else None
        if last and 0 < len(text) < 100 and paragraph and last[1] == paragraph and "table" not in (kind, last[2]):
            last[3] += " " + text
        elif kind == "table" or len(text) >= (15 if paragraph else 25):
            kept.append([page, paragraph, kind, text])
    return kept


def test_merging_equals_the_fold(spark):
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(60):
        parts = []
        for i in range(rng.randrange(0, 40)):
            size = rng.choice([3, 14, 15, 24, 25, 60, 99, 100, 140])
            parts.append((i // 7, rng.choice(["1.1", "1.1", "1.2", None]), rng.choice(["paragraph"] * 4 + ["table"]), chr(97 + i % 26) * size))
        want[doc] = [tuple(x) for x in folded(parts)]
        rows += [(doc, page, i, 0, None, paragraph, kind, text) for i, (page, paragraph, kind, text) in enumerate(parts)]
    df = spark.createDataFrame(rows, "doc_id int, page int, segment int, part int, chapter string, paragraph string, type string, text string")
    got = {d: [] for d in want}
    for r in chunking.merged(df).orderBy("doc_id", "ordinal").collect():
        assert r.ordinal == len(got[r.doc_id])
        got[r.doc_id].append((r.page, r.paragraph, r.type, r.text))
    assert got == want


def test_windows_follow_the_rule():
    import random

    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("abcde .;! ") for _ in range(rng.randrange(0, 400)))
        size, overlap = rng.choice([(40, 8), (60, 30), (25, 0)])
        begin, want = 0, []
        while True:
            window = text[begin : begin + size]
            if begin + size < len(text):
                stops = [i for i in range(len(window) - 1) if window[i] in ".!?;" and window[i + 1] == " " and i > size * 0.55]
                blanks = [i for i, c in enumerate(window) if c == " " and i > size * 0.8]
                window = window[: stops[-1] + 1] if stops else window[: blanks[-1]] if blanks else window
            want.append(window.strip())
            if begin + len(window) >= len(text):
                break
            begin += len(window) - overlap
        assert chunking.split_long(text, size, overlap) == (want if len(text) > size else [text])
    with pytest.raises(ValueError):
        chunking.split_long("x", 10, 8)


def test_chunk_text_is_a_table_function(spark):
    chunking.register(spark)
    text = "Слово и дело. " * 500
    got = spark.createDataFrame([(text,)], "t string").createOrReplaceTempView("texts") or spark.sql("SELECT c.* FROM texts, LATERAL chunk_text(t) c ORDER BY ordinal").collect()
    assert [r.text for r in got] == chunking.split_long(text) and len(got) > 2
