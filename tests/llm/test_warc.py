import base64
import gzip
import hashlib
import io
import json
import random

import duckdb
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from sedge.llm import warc
from sedge.llm.archives import archived_pages, page_records, read_archive, write_archive
from sedge.llm.sql_records import OP11

SCHEMA = "page_id long, url string, html string"


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, min_bytes=0):
    out = []
    for page_id, url, html in rows:
        size = len((html or "").encode())
        same = sorted((r for r in rows if (r[2] or "") == (html or "")), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
        out.append((page_id, size, sha1(html), same, url, html))
    seen, result = set(), []
    for page_id, size, digest, same, url, html in sorted(out, key=lambda r: (r[0] is None, -(r[0] or 0), r[4] is not None, r[4] or "")):
        first = size < min_bytes or digest not in seen
        seen.add(digest)
        result.append((page_id, size, digest, "response" if first else "revisit", None if first else same[0][0]))
    return sorted(result, key=repr)


def random_pages(seed, n):
    rnd = random.Random(seed)
    html = lambda: rnd.choice([None, "", "<p>same</p>", "<p>Ünder</p>\r\n\r\nWARC/1.1\r\n", "<p>" + "x" * rnd.randrange(5), "y" * 200_000])
    rows = [(rnd.choice([None, *range(n)]), rnd.choice([None, "http://a/", "http://b/\r\nWARC-Type: evil"]), html()) for _ in range(n)]
    return rows + rows[:6] + [(n + 1, "http://z/", "<p>same</p>")] * 4


def test_round_trip(spark, tmp_path):
    rows = random_pages(3, 60)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"payload": F.lit("clash"), "digest": F.lit(1)}).repartition(3)
    path = f"file://{tmp_path}/archive"
    write_archive(page_records(df), path)
    assert sorted((tuple(r) for r in archived_pages(spark, path).collect()), key=repr) == plain(rows)
    held = [bytes(r.payload) for r in read_archive(spark, path).where("record_type = 'response'").select("payload").collect()]
    assert sorted(held) == sorted({(h or "").encode() for _, _, h in rows})
    uris = {r.target_uri for r in read_archive(spark, path).select("target_uri").collect()}
    assert uris == {None, "http://a/", "http://z/", "http://b/%0D%0AWARC-Type: evil"}
    # a failed attempt's file is no part of the archive
    (tmp_path / "archive" / "part-9-orphan.warc.gz").write_bytes(b"broken")
    assert read_archive(spark, path).count() == len(rows)


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, None, "abc"), (2, None, "abc"), (3, None, "abcdef"), (4, None, "abcdef"), (5, None, None), (6, None, "")]
    path = f"file://{tmp_path}/a"
    write_archive(page_records(spark.createDataFrame(rows, SCHEMA), min_bytes=4), path)
    assert sorted((tuple(r) for r in archived_pages(spark, path).collect()), key=repr) == plain(rows, 4)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    write_archive(page_records(spark.createDataFrame([], SCHEMA)), path)
    assert archived_pages(spark, path).count() == 0


def test_sql_says_the_same():
    rows = random_pages(4, 50)
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(db.execute(OP11).fetchall(), key=repr) == plain(rows)


def test_filters_reach_the_reader(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    write_archive(page_records(spark.createDataFrame([(i, f"http://{i % 3}/", "same" if i % 2 else str(i)) for i in range(30)], SCHEMA)), path)
    found = read_archive(spark, path, "record_type string, target_uri string, payload_bytes long").where("record_type = 'revisit' and target_uri like 'http://1%' and payload_bytes > 3")
    assert found.count() == sum(1 for i in range(30) if i % 2 and i % 3 == 1 and i != 29)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("BatchScan")[0].split("Filter")[-1] or "Filter" not in plan.split("BatchScan")[0]


def records(data, compressed, **kw):
    return warc.Records(io.BytesIO(data), compressed, **kw)


def sample(n=40, size=100_000):
    rnd = random.Random(1)
    out = []
    for i in range(n):
        block = bytes(rnd.randrange(256) for _ in range(rnd.randrange(50))) + b"\r\n\r\nWARC/1.0\r\n" + bytes(rnd.choices(range(256), k=rnd.choice([0, 10, size])))
        out.append(({"WARC-Type": ("response", "request")[i % 2], "WARC-Record-ID": f"<{i}>"}, block))
    return out


@pytest.mark.parametrize("kind", ["plain", "members", "unmarked", "one stream"])
def test_headers_first(kind):
    made = sample()
    raw = [warc.record_bytes(f, b) for f, b in made]
    data = {"plain": lambda: b"".join(raw), "members": lambda: b"".join(map(warc.member, raw)), "unmarked": lambda: b"".join(map(gzip.compress, raw)), "one stream": lambda: gzip.compress(b"".join(raw))}[kind]()
    if kind != "plain":
        assert gzip.decompress(data) == b"".join(raw)
    got = [(f["warc-record-id"], b) for _, f, b in records(data, kind != "plain")]
    assert got == [(f["WARC-Record-ID"], b) for f, b in made]
    wanted = lambda f: f["warc-type"] == "response"
    reader = records(data, kind != "plain", wanted=wanted)
    assert [b for _, _, b in reader] == [b for f, b in made if f["WARC-Type"] == "response"]
    heads = records(data, kind != "plain", blocks=False)
    assert [f["warc-record-id"] for _, f, _ in heads] == [f["WARC-Record-ID"] for f, _ in made]
    if kind == "members":  # rejected blocks are stepped over, not inflated
        assert heads.inflated < len(b"".join(raw)) // 1.2 and reader.inflated < len(b"".join(raw))


def test_ranges_between_offsets(tmp_path, monkeypatch):
    made = sample(30, 65_536)
    parts = [warc.member(warc.record_bytes(f, b)) for f, b in made]
    ends = [sum(map(len, parts[:i])) for i in range(31)]
    data, cuts = b"".join(parts), [0, ends[7], ends[8], ends[20], None]
    got = [[f["warc-record-id"] for _, f, _ in records(data, True, start=a, stop=b)] for a, b in zip(cuts, cuts[1:])]
    assert [x for part in got for x in part] == [f["WARC-Record-ID"] for f, _ in made] and list(map(len, got)) == [7, 1, 12, 10]
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / warc.MANIFEST).write_text(json.dumps({"files": [{"name": "a.warc.gz", "bytes": len(data), "offsets": cuts[1:-1]}]}))
    planned = warc.plan(str(tmp_path), ends[8])
    assert [(a, b) for p in planned for _, a, b in p.parts] == list(zip(cuts, cuts[1:])) and len(planned) > 1
    with pytest.raises(ValueError):
        list(records(b"no archive", False))


def test_what_filters_say_of_missing_fields():
    fields = {"warc-type": "response", "x-payload-bytes": "12"}
    say = lambda f: warc.holds(f, fields)
    kind, uri, size = ("record_type",), ("target_uri",), ("payload_bytes",)
    assert say(ds.EqualTo(kind, "response")) and say(ds.In(kind, ("x", "response"))) and say(ds.Not(ds.EqualTo(kind, "revisit"))) and say(ds.GreaterThan(size, 11))
    assert say(ds.EqualTo(uri, "x")) is None and say(ds.Not(ds.EqualTo(uri, "x"))) is None and say(ds.IsNull(uri)) and say(ds.In(kind, ("x", None))) is None
    assert say(ds.EqualNullSafe(uri, None)) and not warc.supported(ds.EqualTo(("payload",), b"")) and not warc.supported(ds.EqualTo(("headers", "x"), "y"))
