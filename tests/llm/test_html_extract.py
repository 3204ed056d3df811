from pyspark.sql import functions as F

import html as entities
import os
import re

import pytest

from sedge.llm.html_extract import ARTICLE, DEEP, FURNITURE, JUDGED, OPEN, RUN, SEVERAL, extract_text, page_blocks, repeated_substrings


def page(body, head="<title>t</title><script>var a='</p>';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_blocks():
    html = page(
        "<header>site</header><nav><ul><li>menu</li></ul></nav><!-- x --><div class='ad'>buy</div>"
        "<article><h1>Head &amp; line</h1><p><b>One  \n two&nbsp;three<br>four<p>Five <i>si</i>x &am &amp &#233;</p><div class='comments'><p>me too</p></div>"
        "<aside>side</aside><form>f<button>go</button></form><ul><li>a<li>b</ul><div id='cookie-notice'>ok?</div><footer>tags</footer></article><footer>&copy; x</footer>"
    )
    got = [t for r, _, t in page_blocks(html) if r == ARTICLE]
    assert got == ["Head & line", "One two three four", "Five six &am & é", "a", "b"]
    assert all(r == FURNITURE for r, _, t in page_blocks(html) if t not in got)


def test_pages_without_article_are_open():
    assert page_blocks(page("<nav>m</nav><div><p>text</p></div>")) == [(FURNITURE, 0, "t"), (FURNITURE, 0, "m"), (OPEN, 0, "text")]
    assert page_blocks("") == [] and page_blocks("plain < text") == [(OPEN, 0, "plain < text")]
    assert page_blocks("<main><p>x</main><p>y") == [(ARTICLE, 0, "x"), (FURNITURE, 0, "y")]


def kept(spark, inside):
    df = spark.createDataFrame([(1, "http://a.com/1", page(f"<article><p>first</p>{inside}<p>last</p></article>"))], "page_id long, url string, html string")
    return extract_text(df).first().text.split("\n\n")[1:-1]


def test_names_inside_an_article(spark):
    parts = (
        '<section id="related-work"><p>k1</p></section><div class="article-header"><h2>k2</h2></div><p class="navy">k3</p><p class="advert">g</p><ul><li class="share">g<li>k4</ul>'
        '<div class="commentlist"><p>g</p></div><div class="siteNav">g</div><div class="disqus">g</div><p>k5 <span class="ad">g</span>tail</p><table><tr><td class="sponsored">g<td>k6</table>'
        '<div class="header">k7</div><div class="site-header">g</div><div class="related-reading"><a href=x>g g</a></div><div class="related-reading">k8 <a href=x>l</a></div><p hidden>g<p>k9'
    )
    assert kept(spark, parts) == ["k1", "k2", "k3", "k4", "k5 tail", "k6", "k7", "k8 l", "k9"]


def test_article_within_a_named_wrapper():
    html = page('<div class="has-sidebar"><div class="sidebar">s</div><article><p>a</p></article></div><div class="main-menu"><article>b</article></div><nav><article>c</article></nav>')
    assert [t for r, _, t in page_blocks(html) if r == ARTICLE] == ["a", "b"]
    html = page('<article><p>a<pre>x <span class="comment"># y</span></pre></article><div id="comments"><article class="comment-body">c</article></div><div class="related"><article>d</article></div>')
    assert [t for r, _, t in page_blocks(html) if r == ARTICLE] == ["a", "x # y"]


def test_article_text_that_other_pages_repeat_stays_and_copies_stay(spark):
    notice = " ".join(f"n{i}" for i in range(16))
    passage = " ".join(f"q{i}" for i in range(16))
    copy = "".join(f"<p>{' '.join(f'c{k}x{i}' for i in range(40))}</p>" for k in range(4))
    rows = [
        (1, page(f"<article><p>one</p><p>{notice}</p><p>{passage}</p></article>")), (2, page(f"<article><p>two</p><p>{passage}</p></article><footer>{notice}</footer>")),
        (3, page(f"<article>{copy}</article>")), (4, page(f"<article>{copy}</article>")), (5, page(f"<nav>{copy}</nav><p>five</p>")),
        (6, page(f"<article><div class='related-x'>{passage}</div><p>six</p></article>")), (7, page(f"{copy}<p>seven</p>")), (8, page(f"{copy}<p>eight</p>")),
    ]
    df = spark.createDataFrame([(i, "http://h.com/x", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(df).collect()}
    plain = "\n\n".join(" ".join(f"c{k}x{i}" for i in range(40)) for k in range(4))
    assert got == {1: f"one\n\n{notice}\n\n{passage}", 2: f"two\n\n{passage}", 3: plain, 4: plain, 5: "five", 6: "six", 7: plain + "\n\nseven", 8: plain + "\n\neight"}


def test_repeats_equal_brute_force(spark):
    import random

    rng = random.Random(9)
    runs = [[f"r{k}_{i}" for i in range(rng.randrange(6, 140))] for k in range(6)]
    streams = []
    for page_id in range(24):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(0, 6))] + rng.choice(runs)[rng.randrange(3) :]
        streams.append((f"h{page_id % 2}", page_id, page_id * 10, words))
    streams += [("h0", 3, 31, streams[3][3])]  # another row of page 3
    want = {}
    for host, page_id, row, words in streams:
        for at in range(len(words) - RUN + 1):
            depth, size = 0, RUN
            while size <= DEEP and at + size <= len(words):
                same = any(h == host and p != page_id and words[at : at + size] == w[b : b + size] for h, p, _, w in streams for b in range(len(w) - size + 1))
                if not same:
                    break
                depth, size = size, size * 2
            if depth:
                want[row, at] = depth
    df = spark.createDataFrame([(h, p, r, " ".join(w), [OPEN | JUDGED] * bool(w), [len(w)] * bool(w)) for h, p, r, w in streams], "host string, page_id long, row long, stream string, kinds array<tinyint>, sizes array<int>")
    assert {(r.row, r.at): r.depth for r in repeated_substrings(df).collect()} == want and DEEP in want.values()


def texts_of(spark, rows):
    """Texts of (host, blocks of an article), in order."""
    rows = [(i, f"http://{host}/{i}", page("<nav>m</nav><article>" + "".join(b if b[0] == "<" else f"<p>{b}</p>" for b in blocks) + "</article>")) for i, (host, blocks) in enumerate(rows)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text.split("\n\n") for r in sorted(got, key=lambda r: r.page_id)]


def test_what_most_articles_of_a_host_end_or_begin_with_goes(spark):
    run = lambda name, n=RUN + 7: " ".join(f"{name}{i}" for i in range(n))
    letter, rights, top, quote = run("l"), "all rights reserved", run("t"), run("q")
    own = lambda k: [f"story {k}", run(f"s{k}x", 30)]
    doubt = lambda k: f"<div class='related-reading'><p>see {k} too</p></div>"
    rows = {
        "all.com": [([letter] if k == 7 else []) + [top, *own(k), letter, rights, doubt(k)] for k in range(12)],
        "short.com": [[f"story {k}", letter] for k in range(4)],
        "few.com": [[*own(k), letter] for k in range(SEVERAL - 1)],
        "part.com": [[*own(k), *[letter] * (k < 5)] for k in range(7)],
        "most.com": [[*own(k), *[letter] * (k < 6)] for k in range(8)],
        "middle.com": [[*own(k), quote, run(f"e{k}x")] for k in range(6)],
        "copies.com": [[*own(1), letter]] * 9,
        "near.com": [[*own(1)[:1], run("v", 60) + f" {k}", letter] for k in range(9)],
        "long.com": [[f"story {k}", run("d", DEEP)] for k in range(6)],
        "brief.com": [[*own(k), rights] for k in range(6)],
        "titles.com": [["the same title again", run(f"s{k}x", 30), letter] if k % 2 else ["the same title again", letter] for k in range(12)],
        "heads.com": [[top, "the same title again" if k < 5 else f"story {k}", run(f"s{k}x", 30)] for k in range(12)],
        "only.com": [[*own(k), letter] for k in range(6)] + [[top, letter], [letter]],
    }
    got = iter(texts_of(spark, [(host, blocks) for host, pages in rows.items() for blocks in pages]))
    got = {host: [next(got) for _ in pages] for host, pages in rows.items()}
    plain = dict(rows)
    plain["all.com"] = [([letter, top] if k == 7 else []) + [*own(k), f"see {k} too"] for k in range(12)]
    plain["short.com"] = [[f"story {k}"] for k in range(4)]
    plain["most.com"] = [own(k) for k in range(8)]
    plain["titles.com"] = [["the same title again", run(f"s{k}x", 30)] if k % 2 else ["the same title again"] for k in range(12)]
    plain["heads.com"] = [blocks[1:] for blocks in rows["heads.com"]]
    plain["only.com"] = [own(k) for k in range(6)] + [[top], [letter]]
    assert got == plain


def test_ends_of_articles_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    pool = [" ".join(f"p{k}_{i}" for i in range(n)) for k, n in enumerate((40, 5, 14))]
    rows = []
    for k in range(90):
        own = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 4))]
        side = lambda sizes: rng.choices(pool, (1, 2, 60), k=rng.choice(sizes))
        rows.append((f"h{k % 6}.com", side([0] + [1] * 9) + own * (k % 19 > 0) + side([0] + [1] * 9 + [2]) or own))
    rows += rows[:20]  # copies

    def sides(blocks):
        size = [len(b.split()) for b in blocks]
        for cut in range(1, len(blocks)):
            for side, part, n, beside in (("head", blocks[:cut], sum(size[:cut]), blocks[cut]), ("tail", blocks[cut:], sum(size[cut:]), blocks[cut - 1])):
                if n >= RUN and (n < DEEP or 2 * n <= sum(size)):
                    yield side, tuple(part), beside

    articles, beside, having = {}, {}, {}
    for host, blocks in rows:
        articles.setdefault(host, set()).add(tuple(blocks))
        for side, part, near in sides(blocks):
            beside.setdefault((host, side, part), set()).add(near)
            having.setdefault((host, side, part), set()).add(tuple(blocks))
    want, cuts = [], set()
    for host, blocks in rows:
        goes = {"head": 0, "tail": 0}
        for side, part, _ in sides(blocks):
            have = len(having[host, side, part])
            if have >= len(articles[host]) * 3 / 4 and len(beside[host, side, part]) >= max(SEVERAL, have / 4):
                goes[side] = max(goes[side], len(part))
        head, tail = goes["head"], goes["tail"]
        stays = head + tail >= len(blocks)
        want.append(blocks if stays else blocks[head : len(blocks) - tail])
        cuts.add((head > 0, tail > 0, stays))
    assert texts_of(spark, rows) == want and len(cuts) == 5


def test_very_long_pages(spark):
    text = " ".join(f"w{i}" for i in range(80_000))
    df = spark.createDataFrame([(1, "http://a.com", page(f"<article><p>{text}</p></article>")), (2, "http://a.com", page(f"<p>{text}"))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(df).collect()}
    assert got[1] == text and got[2] == text


def test_repeated_substrings_of_a_host_go(spark):
    boiler = " ".join(f"b{i}" for i in range(RUN + 4))
    same = " ".join(f"s{i}" for i in range(30))
    rows = [
        (1, "http://h.com/1", page(f"<div><p>unique words one</p><p>{boiler}</p></div>")),
        (2, "http://h.com/2", page(f"<div><p>{boiler} own tail</p><p>other text</p></div>")),
        (3, "http://other.com/3", page(f"<p>{boiler}</p>")),
        (4, "http://h.com/4", page(f"<article><p>{same}</p></article>")),
        (5, "http://h.com/5", page(f"<article><p>{same}</p></article><footer>{boiler}</footer>")),
        (6, None, None), (7, "http://h.com/7", ""), (8, "http://z.com/8", page(f"<p>{same}</p>")), (8, "http://z.com/8", page(f"<p>{same}</p>")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("row", F.lit(1))
    got = sorted((r.page_id, r.url, r.text) for r in extract_text(df).collect() if r.url)
    want = ["unique words one", "own tail\n\nother text", boiler, same, same, "", same, same]
    assert [t for _, _, t in got] == want
    assert [r.text for r in extract_text(df).where("page_id = 6").collect()] == [""]
    assert extract_text(df.where("1 = 0")).count() == 0


def test_names_that_say_nothing(spark):
    heads = "".join(f'<h2 id="{name}">{name} h</h2>' for name in ("navigation", "notice", "comments", "sharing", "menus"))
    sections = "".join(f'<section id="{name}"><p>{name} s</p></section>' for name in ("promotion", "ads", "banners"))
    want = [f"{n} h" for n in ("navigation", "notice", "comments", "sharing", "menus")] + [f"{n} s" for n in ("promotion", "ads", "banners")] + ["see the link here"]
    assert kept(spark, f'{heads}{sections}<p>see <a class="link related">the link</a> here') == want


def test_comments_and_hidden_parts(spark):
    gone = (
        "<article><p>a reader's word</p></article>" + "".join(f'<div class="{c}"><p>g</p></div>' for c in ("talkback", "responses", "user-reviews"))
        + '<div style="color:red; display: none">g</div><p>k <span style="visibility:hidden">g</span>end'
    )
    assert kept(spark, gone) == ["k end"]
    assert [t for k, _, t in page_blocks("<article><article><p>inner</p></article></article>") if k == ARTICLE] == ["inner"]


def test_the_smallest_article_wins():
    got = page_blocks("<main><div>Teaser</div><article><p>x</p></article><p>more</p></main>")
    assert got == [(FURNITURE, 0, "Teaser"), (ARTICLE, 0, "x"), (FURNITURE, 0, "more")]


_BLOCK = re.compile(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote|pre|table|tr|td|th|section)\b[^>]*>")


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="needs the given tables")
def test_all_given_pages_return_their_article(spark):
    """Every block of the <article> element of every given page, by plain string work."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if inner:
            blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in _BLOCK.split(inner[1]))
            want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert len(want) > 200 and {k: got[k] for k in want} == want
