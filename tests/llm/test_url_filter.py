import duckdb
import pytest
from pyspark.sql import functions as F

from sedge.llm import components
from sedge.llm.components import connected_components
from sedge.llm.sql import SQL
from sedge.llm.url_filter import PAGES_RULES, filter_urls, page_links, resolved


def judged(spark, rows, rules=PAGES_RULES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("url_key", F.lit("clash"))
    return {r.page_id: (r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in filter_urls(df, rules, page_links(df)).collect()}


def link(href):
    return f"<html><head><link rel='canonical' href='{href}'></head><body>x</body>"


def test_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/1?q#f", None), (2, "http://a.example.net/de/1", ""), (3, "https://notexample.net/en/x", None), (4, "http://example.com/de/", None),
        (5, "http://x.org/fr/a", None), (6, "http://x.org", None), (7, None, None), (8, "no scheme/x", None), (9, "http://net", None), (10, "a://b://c/d", None), (11, "://net/#/x", None),
    ]
    assert judged(spark, rows) == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("a.example.net", "/de/1", "net/", "block"), 3: ("notexample.net", "/en/x", "net/", "block"),
        4: ("example.com", "/de/", "example.com/de/", "block"), 5: ("x.org", "/fr/a", "org/fr/", "allow"), 6: ("x.org", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("net", "", None, "allow"), 10: ("b:", "//c/d", None, "allow"), 11: ("net", "/", "net/", "block"),
    }


def test_block_decisions_reach_aliases(spark):
    rows = [
        (1, "http://a.com/1", link("http://b.com/2")), (2, "http://b.com/2", '<meta http-equiv="Refresh" content="0; url=http://bad.net/x"><body>'), (3, "http://c.com/3", link("//b.com/2#part")),
        (4, "http://d.com/4", link("http://e.org/fr/ok")), (5, "http://f.com/5", link("http://D.com/4")), (6, "http://g.com/6", link("http://d.com/4")), (7, "http://h.net/7", link("http://d.com/4")),
        (8, "http://i.com/a/8", link("../x")), (9, "http://i.com/9", "<body><link rel=canonical href=http://bad.net/>"), (10, "https://a.com/1#x", None), (1, "http://a.com/1", link("http://b.com/2")),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    # d.com's class holds an allowed and (h.net) a blocked url: explicit allow wins for those without a rule
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow", 10: "block"}


def test_all_links_of_a_head(spark):
    two = "<head><link rel=canonical href='http://x.com/1'><LINK href='http://bad.net/' REL='canonical'></head><BODY><link rel=canonical href='http://e.org/fr/'>"
    df = spark.createDataFrame([(1, "http://a.com/1", two), (2, "http://a.com/2", None)], "page_id long, url string, html string")
    assert sorted(r.target for r in page_links(df).collect()) == ["http://bad.net/", "http://x.com/1"]
    assert judged(spark, [(1, "http://a.com/1", two), (1, "http://a.com/1", two), (3, "http://x.com/1", "x" * 300_000)])[3][3] == "block"
    assert filter_urls(df.where("1 = 0"), PAGES_RULES, page_links(df.where("1 = 0"))).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_chains_and_hubs(spark, monkeypatch, few):
    monkeypatch.setattr(components, "MAX_BROADCAST_NODES", few)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (None, 3), (7, None), (2000, 2001), (2001, 2000), (2000, 2001)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1301)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty(spark):
    assert judged(spark, []) == {} and judged(spark, [(1, "http://a.net/", None)], [])[1][3] == "allow"


def test_urls_without_a_host_are_no_nodes(spark):
    rows = [(1, "abc", link("https://x.net/")), (2, "mailto:q", None), (3, "http://ok.com/a", link("mailto:q")), (4, None, link("http://bad.net/"))]
    assert {k: v[3] for k, v in judged(spark, rows).items()} == {1: "allow", 2: "allow", 3: "allow", 4: "allow"}


def test_references_of_rfc_3986(spark):
    """The examples of section 5.4, but for the fragment-only forms, which lose their fragment as keys do."""
    base = "http://a/b/c/d;p?q"
    want = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "g?y#s": "http://a/b/c/g?y#s",
        ";x": "http://a/b/c/;x", "#s": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g",
        "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
        "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x", "g:h": "g:h",
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.full for r in df.select("t", resolved(F.col("t"), F.lit(base)).alias("full")).collect()} == want


def test_sql_follows_the_same_links(spark):
    rows = [
        (1, "http://a.com/x/1?k=1", link("?k=2")), (2, "http://a.com/x/1?k=2", link("../y/./2")), (3, "http://a.com/y/2", "<head><base href='//b.com/z/'><link href=\"q\" rel=canonical></head>"),
        (4, "http://b.com/z/q", "<meta http-equiv=refresh content='0;URL=http://c.net/'>"), (5, "http://d.com/", "<!-- <link rel=canonical href='http://c.net/'> --><link rel=canonical href='http://e.org/fr/1'>"),
        (6, "HTTP://D.com", None), (7, "abc", link("https://x.net/")), (8, "mailto:q", None), (9, None, None), (10, "http://f.com/a", link("mailto:q")), (11, "http://g.com", link("x&amp;y")), (12, "http://g.com/x&y", link("http://h.net")),
    ]
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    got = judged(spark, rows)
    assert {r[0]: r[1:] for r in db.execute(SQL["op7_redirect_url_filter"]).fetchall()} == got
    assert [got[k][3] for k in range(1, 13)] == ["block"] * 4 + ["allow"] * 6 + ["block"] * 2
