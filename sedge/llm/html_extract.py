"""Main text of web pages, with a suffix array over each host's pages.

A page is read into blocks with what its markup says of them: the article,
furniture (menus, headers, footers, adverts, forms, comments, ...), or open
where it doesn't tell; a name alone (a class or an id) that only hints at
furniture is a doubt.  All that the markup doesn't call furniture is judged by
repetition.  For open blocks of pages without an article and for doubtful
blocks of articles, the token streams of all blocks are concatenated by host,
and equal suffixes are found to a depth of 96 tokens:

* minimizers of each page's stream, which equal substrings of 12 tokens share,
  tell in one grouped count which substrings of judged blocks other pages of
  the host may repeat, wherever they have them;
* there suffixes get the name of their first 12 tokens, and names double:
  the name of 24 tokens is the pair of the names of two neighbours, and so on.
  Suffixes of one name stand together in the array to that depth, and a name
  that one page alone has is dropped, so only repeated substrings go on.

Plain blocks of an article are its text, also where other pages quote them; but
what most articles of a host end or begin with is a notice that no markup
tells.  Here the suffixes that begin at a block and run to the end of the
article (and the same read backwards, from its beginning) are named as a whole.
One of 12 tokens and more is no part of the article if at least 4 different
articles of the host, and at least three quarters of them, have it, next to as
many different blocks as 4 and a quarter of these articles: versions of one
article don't tell a notice.

Then blocks are judged.  Doubtful blocks go if they are mostly links or mostly
repeated on other pages; open blocks lose what is repeated and keep their
unique runs.  Repeats of 96 tokens and more over half of a page's text mean
that the page is a copy, which is no boilerplate: copies of one text on
several pages are each returned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import counted, materialize, semi_reduce, text_batches
from .substring_dedup import Digests, minimizer
from .url_filter import host_of
from .words import mix, slices, strings, word_table

#: Tokens of a repeated substring at least, and of a minimizer.
RUN, SEED = 12, 4
#: How often names double: to 12 * 2 ** 3 = 96 tokens.
DOUBLINGS = 3
DEEP = RUN << DOUBLINGS

#: Different articles that must share an end or a beginning which is taken away; three quarters of the host's must as well
#: (a line that texts have in common opens up to 41 % of a host's articles in the tables at hand, a notice nearly all).
SEVERAL = 4
#: Sides of an article: the whole, its beginning, its end.
WHOLE, HEAD, TAIL = 0, 1, 2

#: Places of repeats (9 bytes each) up to which they go to the pages; beyond it pages and repeats are shuffled.
MAX_BROADCAST_PLACES = 2_000_000

ARTICLE, FURNITURE, OPEN, DOUBT = 0, 1, 2, 4
#: Further bits: repetition decides; in <main> but in no <article>.
JUDGED, MAIN = 8, 16
_TAGS = frozenset("head title script style noscript template nav header footer aside form button select textarea iframe svg object dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Parts of names that mean furniture (as beginnings of a word, or whole).
_BEGIN = re.compile(r"advert|sponsor|promo|nav(?!y|al)|menu|breadcrumb|cookie|comment|disqus|subscri|newsletter|sidebar|popup|banner|paywall")
_WHOLE = frozenset("ad ads share sharing social related talkback responses reviews feedback discussion replies reply consent modal notice notices footer header aside recommended masthead toolbar".split())
#: Parts of names that say nothing; with these alone a name is certain.
_PLAIN = frozenset("user users reader readers customer site page top bottom left right main global box block list item items wrap wrapper container section area widget bar links link inner outer post posts entry content text body div row col primary secondary buttons button icons the".split())
#: Of these, what names parts of a layout, which may wrap an article as well.
_LAYOUT = re.compile(r"nav|menu|sidebar|banner|header|footer|aside|masthead|toolbar|breadcrumb")
#: What hides words within a line.
_INLINE_JUNK = re.compile(r"(ads?|advert\w*|sponsor\w*|promo\w*|shar(e|ing)|social)$")
_HIDDEN = re.compile(r"(?i)(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)")
#: Elements whose id is a slug of their words, which says nothing inside an article.
_SLUGS = frozenset("h1 h2 h3 h4 h5 h6 section".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes without an end tag, and where that stops.
_CELLS, _TABLE = frozenset(("td", "th")), frozenset(("table",))
_ROWS, _PARTS_OF_TABLE = _CELLS | {"tr"}, frozenset(("thead", "tbody", "tfoot"))
_CLOSES = (
    {"li": ({"li"}, {"ul", "ol", "menu"}), "tr": (_ROWS, _TABLE | _PARTS_OF_TABLE), "option": ({"option"}, {"select"})}
    | dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"}))
    | dict.fromkeys(_CELLS, (_CELLS, _TABLE | {"tr"}))
    | dict.fromkeys(_PARTS_OF_TABLE, (_ROWS | _PARTS_OF_TABLE, _TABLE))
)


def name_says(names: str) -> tuple[int, bool]:
    """FURNITURE or DOUBT by the names of an element (class and id), else 0; and whether a layout is named.

    A name is certain if, of its parts, all that aren't plain mean furniture.
    """
    said = 0
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        junk = [p for p in parts if p in _WHOLE or _BEGIN.match(p)]
        if junk and all(p in _PLAIN or p in junk or p.isdigit() for p in parts):
            return FURNITURE, all(_LAYOUT.match(p) for p in junk)
        if junk:
            said = DOUBT
    return said, False


class _Blocks(HTMLParser):
    """Blocks (kind, share of links, text) of a page in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, float, str]] = []
        self.parts: list[str] = []
        self.linked = self.anchors = 0
        self.open: list[tuple[str, int, bool]] = []  # tag, kind outside, by name only outside
        self.kind, self.by_name = OPEN, False
        self.begun = 0  # blocks before the outermost open article
        self.skipped: list[str] = []  # open inline elements that are left out

    def cut(self) -> None:
        raw = "".join(self.parts)
        if text := " ".join(raw.split()):
            self.blocks.append((self.kind, self.linked / len(raw), text))
        self.parts, self.linked = [], 0

    def leave(self, i: int) -> None:
        """Close open[i] and all inside it."""
        self.cut()
        _, self.kind, self.by_name = self.open[i]
        del self.open[i:]

    def imply_ends(self, tag: str) -> None:
        if self.open and self.open[-1][0] == "p":
            self.leave(len(self.open) - 1)
        closed, stops = _CLOSES.get(tag, ((), ()))
        for i in range(len(self.open) - 1, -1, -1) if closed else ():
            if self.open[i][0] in closed:
                self.leave(i)
            elif self.open[i][0] in stops or self.open[i][0] in ("article", "main", "body"):
                break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = dict(attrs)
        inside = self.kind & 3 == ARTICLE
        names = f"{at.get('class') or ''} {'' if inside and tag in _SLUGS else at.get('id') or ''}"
        said, layout = name_says(names) if "class" in at or "id" in at else (0, False)
        hidden = "hidden" in at or at.get("aria-hidden") == "true" or (at.get("role") or "").lower() in _ROLES or bool(_HIDDEN.search(at.get("style") or ""))
        if tag in _INLINE:
            self.parts.append(" " if tag == "br" else "")
            if tag in _VOID:
                return
            code = any(t == "pre" for t, _, _ in self.open)  # names of highlighted code say nothing
            junk = said == FURNITURE and not code and any(_INLINE_JUNK.match(p.lower()) for p in _PARTS.findall(names))
            if self.skipped or hidden or junk:
                self.skipped.append(tag)
            self.anchors += tag == "a"
            return
        self.skipped, self.anchors = [], 0
        self.cut()
        self.imply_ends(tag)
        if tag in _VOID:
            return
        self.open.append((tag, self.kind, self.by_name))
        inside = self.kind & 3 == ARTICLE
        if tag in ("html", "body") or (self.kind == FURNITURE and not self.by_name):
            return
        nested = tag == "article" and inside and not self.kind & MAIN
        if nested and any(kind & 3 == ARTICLE for kind, _, _ in self.blocks[self.begun :]):
            self.kind, self.by_name = FURNITURE, False  # an article about the one around it: a comment
        elif tag == "article" and not hidden and not nested and (said != FURNITURE or layout):
            self.kind, self.by_name, self.begun = ARTICLE, False, len(self.blocks)  # also within what a name alone marks
        elif tag == "main" and not hidden and not inside and (said != FURNITURE or layout):
            self.kind, self.by_name = ARTICLE | MAIN, False
        elif self.kind == FURNITURE:
            return
        elif (tag in _TAGS and not (inside and tag == "header")) or hidden:
            self.kind, self.by_name = FURNITURE, False
        elif said == FURNITURE and not (inside and _own_header(at)):
            self.kind, self.by_name = FURNITURE, layout
        elif said:
            self.kind |= DOUBT

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _INLINE:
            self.anchors -= tag == "a" and self.anchors > 0
            if tag in self.skipped:
                del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
            return
        self.skipped, self.anchors = [], 0
        self.cut()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.leave(i)
                break

    def handle_data(self, data: str) -> None:
        if not self.skipped and (not self.open or self.open[-1][0] not in ("script", "style", "template")):
            self.parts.append(data)
            self.linked += len(data) if self.anchors else 0


def _own_header(at: dict) -> bool:
    """An article's header by name (class="header") is its own, as <header> is."""
    parts = {p.lower() for p in _PARTS.findall(f"{at.get('class') or ''} {at.get('id') or ''}")}
    return "header" in parts and not any(p in _WHOLE - {"header"} or _BEGIN.match(p) or p == "site" for p in parts)


def page_blocks(html: str) -> list[tuple[int, float, str]]:
    """(kind, share of links, text) of the blocks of a page, character references decoded.

    If the page marks an article with text, blocks outside it are furniture; main counts where no article does.
    """
    reader = _Blocks()
    reader.feed(html)
    reader.close()
    reader.cut()
    own = [ARTICLE if kind & 3 == ARTICLE and not kind & MAIN else OPEN if kind & 3 == ARTICLE else None for kind, _, _ in reader.blocks]
    best = ARTICLE if ARTICLE in own else OPEN if OPEN in own else None
    return [(kind & ~MAIN if best is None or mine == best else FURNITURE, link, text) for mine, (kind, link, text) in zip(own, reader.blocks)]


def judged_kinds(kinds: list[int]) -> list[int]:
    """Kinds of a page's blocks, with JUDGED where repetition decides."""
    article = any(kind & 3 == ARTICLE for kind in kinds)
    return [kind | JUDGED if (kind & 3 == ARTICLE and kind & DOUBT if article else kind & 3 == OPEN) else kind for kind in kinds]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as streams: a block is a line, with its kind, its share of links and its number of tokens."""
    for batch in batches:
        stream, kinds, links, sizes = [], [], [], []
        for html in strings(batch.column("html")):
            blocks = page_blocks(html.as_py())
            stream.append("\n".join(text for _, _, text in blocks))
            kinds.append(judged_kinds([kind for kind, _, _ in blocks]))
            links.append([link for _, link, _ in blocks])
            sizes.append([text.count(" ") + 1 for _, _, text in blocks])
        columns = [*(batch.column(c) for c in ("page_id", "url", "row", "host")), pa.array(stream), pa.array(kinds, pa.list_(pa.int8())), pa.array(links, pa.list_(pa.float32())), pa.array(sizes, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "row", "host", "stream", "kinds", "links", "sizes"])


class _Tokens:
    """The tokens of a slice of streams: their page, kind, and the minimizer of the RUN tokens from each."""

    def __init__(self, batch: pa.RecordBatch, stream: pa.Array, at: int, rows: int):
        w = word_table(stream.slice(at, rows))
        n = len(w.hash)
        flat = lambda c: batch.column(c).slice(at, rows).flatten().to_numpy(zero_copy_only=False)
        self.ptr, self.digests = w.ptr, Digests(w)
        self.page = np.repeat(np.arange(rows), np.diff(w.ptr))
        self.kind = np.repeat(flat("kinds"), flat("sizes"))
        place = np.arange(max(n - SEED + 1, 0))
        self.seed = self.digests.of(place, place + SEED)[0]
        starts = np.arange(max(n - RUN + 1, 0))
        self.start = starts[self.page[: len(starts)] == self.page[RUN - 1 :]] if len(starts) else starts
        self.least = minimizer(self.seed, RUN - SEED + 1)[self.start] if len(starts) else starts

    def judged_at(self, place: np.ndarray) -> np.ndarray:
        """Whether a judged block has any of the RUN tokens to either side of a place."""
        marks = np.append(0, np.cumsum((self.kind & JUDGED) > 0))
        low, high = np.maximum(place - RUN, self.ptr[self.page[place]]), np.minimum(place + RUN, self.ptr[self.page[place] + 1])
        return marks[high] > marks[low]

    def on_page(self, page: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return mix(seed ^ mix(page.astype(np.uint64)))


def _taken(batch: pa.RecordBatch, at: int, rows: int, page: np.ndarray) -> list[pa.Array]:
    return [batch.column(c).slice(at, rows).take(pa.array(page)) for c in ("host", "page_id", "row")]


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page_id, row, seed, judged): the distinct minimizers of each page's stream, and which stand in judged blocks."""
    for batch in batches:
        stream = strings(batch.column("stream"))
        for at, rows in slices(stream):
            t = _Tokens(batch, stream, at, rows)
            place = np.unique(t.least)
            if not len(place):
                continue
            page, seed, judged_ = t.page[place], t.seed[place], t.judged_at(place)
            order = np.lexsort((seed, page))
            page, seed = page[order], seed[order]
            first = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (seed[1:] != seed[:-1])))
            judged_ = np.logical_or.reduceat(judged_[order], first)
            yield pa.RecordBatch.from_arrays(
                [*_taken(batch, at, rows, page[first]), pa.array(seed[first].view(np.int64)), pa.array(judged_)], names=["host", "page_id", "row", "seed", "judged"]
            )


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page_id, row, at, name, judged) of the suffixes whose minimizer ("seeds") is repeated."""
    for batch in batches:
        stream = strings(batch.column("stream"))
        for at, rows in slices(stream):
            t = _Tokens(batch, stream, at, rows)
            asked = batch.column("seeds").slice(at, rows)
            owner = np.repeat(np.arange(rows), asked.value_lengths().to_numpy())
            asked = t.on_page(owner, asked.flatten().to_numpy().view(np.uint64))
            place = t.start[np.isin(t.on_page(t.page[t.start], t.seed[t.least]), asked)]
            page, judged_ = t.page[place], t.judged_at(place)
            name = t.digests.of(place, place + RUN)[0]
            yield pa.RecordBatch.from_arrays(
                [*_taken(batch, at, rows, page), pa.array((place - t.ptr[page]).astype(np.int32)), pa.array(name.view(np.int64)), pa.array(judged_)],
                names=["host", "page_id", "row", "at", "name", "judged"],
            )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, row, side, blocks, name, article, beside): the ends and beginnings of articles at each of their blocks, and each article as a whole.

    article: the digest of the whole; beside: the least seed of the block next
    to it, which nearly equal blocks share.  From DEEP tokens on, what is more
    than half of an article is none of its sides.
    """
    for batch in batches:
        texts, sizes = [], []
        for stream, kinds, size in zip(strings(batch.column("stream")), batch.column("kinds"), batch.column("sizes")):
            plain = np.asarray(kinds.values) == ARTICLE
            texts.append("\n".join(line for line, own in zip(stream.as_py().split("\n"), plain) if own) if plain.any() else "")
            sizes.append(np.asarray(size.values)[plain])
        stream = pa.array(texts, pa.string())
        for at, rows in slices(stream):
            w = word_table(stream.slice(at, rows))
            digests, n = Digests(w), len(w.hash)
            if not n:
                continue
            end = np.cumsum(np.concatenate(sizes[at : at + rows]).astype(np.int64))
            start = np.append(0, end[:-1])
            page = np.searchsorted(w.ptr, start, side="right") - 1  # of each block
            low, high = w.ptr[page], w.ptr[page + 1]
            seed = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
            place = np.arange(max(n - SEED + 1, 0))
            seed[place] = digests.of(place, place + SEED)[0]
            seed[np.arange(n) > np.repeat(end - SEED, end - start)] = np.iinfo(np.uint64).max  # those that leave their block
            beside = np.where(end - start >= SEED, np.minimum.reduceat(seed, start), digests.of(start, end)[0])
            nth = np.arange(len(end)) - np.searchsorted(start, low)
            blocks = np.bincount(page, minlength=rows)[page]
            cut = np.flatnonzero(end < high)  # blocks with another one behind
            first = np.flatnonzero(start == low)
            article = digests.of(low, high)[0]
            parts = [(TAIL, cut, end[cut], high[cut], blocks[cut] - nth[cut] - 1, beside[cut]), (HEAD, cut, low[cut], end[cut], nth[cut] + 1, beside[cut + 1] if len(cut) else beside[cut])]
            none = np.zeros(len(first), dtype=np.uint64)
            fields = [[np.full(len(first), WHOLE)], [page[first]], [blocks[first]], [none], [article[first]], [none]]
            for side, block, a, b, count, near in parts:
                size = b - a
                ok = (size >= RUN) & ((size < DEEP) | (2 * size <= (high - low)[block]))
                for field, values in zip(fields, (np.full(len(block), side), page[block], count, digests.of(a, b)[0], article[block], near)):
                    field.append(values[ok])
            side, page, blocks, *hashes = (np.concatenate(field) for field in fields)
            host, row = (batch.column(c).slice(at, rows).take(pa.array(page)) for c in ("host", "row"))
            yield pa.RecordBatch.from_arrays(
                [host, row, pa.array(side.astype(np.int8)), pa.array(blocks.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in hashes)],
                names=["host", "row", "side", "blocks", "name", "article", "beside"],
            )


def _shares(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(marks))
    return np.diff(total[np.append(0, ends)]) / np.maximum(np.diff(np.append(0, ends)), 1)


def judged(lines: list[str], kinds: np.ndarray, links: np.ndarray, repeats: dict[str, np.ndarray]) -> list[str]:
    """The blocks that are kept, or what is left of them.

    `repeats`: the places in the stream of repeated substrings of RUN tokens
    ("at") and of those of DEEP tokens ("deep"); and the numbers of plain
    blocks of an article that the host's articles begin with ("head") and end
    with ("tail").
    """
    own = ARTICLE if (kinds & 3 == ARTICLE).any() else OPEN
    plain = np.flatnonzero(kinds == ARTICLE)
    head, tail = (int(repeats[c].max(initial=0)) for c in ("head", "tail"))
    if head + tail < len(plain):  # else nothing else would be left
        kinds = kinds.copy()
        kinds[plain[:head]] = kinds[plain[len(plain) - tail :]] = FURNITURE
    if not len(repeats["at"]):  # nothing is repeated: the markup and the links decide
        return [line for line, kind, link in zip(lines, kinds.tolist(), links.tolist()) if kind & 3 == own and not (kind & DOUBT and link >= 0.5)]
    words = [line.split() for line in lines]
    ends = np.cumsum(np.array([len(x) for x in words], dtype=np.int64))
    n = int(ends[-1]) if len(ends) else 0

    def marked(places: np.ndarray, size: int) -> np.ndarray:
        mark = np.zeros(n + 1, dtype=np.int64)
        np.add.at(mark, places, 1)
        np.add.at(mark, np.minimum(places + size, n), -1)
        return np.cumsum(mark[:-1]) > 0

    repeated, deep = (marked(repeats[c], size) for c, size in (("at", RUN), ("deep", DEEP)))
    within = np.repeat(kinds & 3 == own, np.diff(np.append(0, ends)))
    copy = 2 * int((deep & within).sum()) > int(within.sum())
    boilerplate = repeated & ~deep if copy else repeated
    doubtful = ((kinds & DOUBT) > 0) & ((links >= 0.5) | (_shares(boilerplate, ends) >= 0.5))
    kept = []
    for i, line in enumerate(lines):
        if kinds[i] & 3 != own or doubtful[i]:
            continue
        span = slice(ends[i] - len(words[i]), ends[i])
        if own == ARTICLE:
            kept.append(line)
        elif left := [w for w, gone in zip(words[i], boilerplate[span]) if not gone]:
            kept.append(line if len(left) == len(words[i]) else " ".join(left))
    return kept


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, dtype=np.int64)
    for batch in batches:
        out = []
        for i, stream in enumerate(batch.column("stream")):
            lines = stream.as_py().split("\n") if stream.as_py() else []
            kinds, links = (np.asarray(batch.column(c)[i].values) for c in ("kinds", "links"))
            found = batch.column("found")[i]
            at, depth = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "depth")) if found.is_valid else (none, none)
            at = at.astype(np.int64)
            repeats = {"at": at[depth > 0], "deep": at[depth >= DEEP], "head": at[depth == -HEAD], "tail": at[depth == -TAIL]}
            out.append("\n\n".join(judged(lines, kinds, links, repeats)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def repeated_substrings(streams: DataFrame) -> DataFrame:
    """(row, at, depth): the places where another page of the host repeats RUN tokens or more, as far as a judged block has them.

    `streams` has host, page_id, row (a hash of the row), stream, and the kinds
    (with JUDGED) and sizes (in tokens) of its blocks.
    depth: to how many tokens (doubled up to DEEP) the suffix there has an
    equal one.
    """
    streams = streams.withColumn("host", F.xxhash64("host"))
    minimizers = streams.select("host", "page_id", "row", "stream", "kinds", "sizes").mapInArrow(_minimizers, "host long, page_id long, row long, seed long, judged boolean")
    minimizers = minimizers.withColumn("key", F.xxhash64("host", "seed"))
    # what no judged block has can decide nothing; the others are counted on all pages, in whatever block
    asked = materialize(minimizers.where("judged").select("key").distinct(), "judged")
    seeds = materialize(semi_reduce(minimizers, asked, "key", asked.count()), "seeds")
    near = seeds.groupBy("key").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"))
    shared = materialize(near.where("a < b").select("key"), "shared")
    asked = semi_reduce(seeds, shared, "key", shared.count()).groupBy("row").agg(F.collect_set("seed").alias("seeds"))
    asked = counted(materialize(asked, "asked"))  # streams are not shuffled for few pages
    suffixes = streams.join(asked, "row").select("host", "page_id", "row", "stream", "kinds", "sizes", "seeds")
    suffixes = suffixes.mapInArrow(_suffixes, "host long, page_id long, row long, at int, name long, judged boolean")

    on_several = (F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.max("judged").alias("judged"))
    found, depth = None, RUN
    level = materialize(suffixes.dropDuplicates(["row", "at"]), "suffixes")
    while True:
        names = level.groupBy("host", "name").agg(*on_several).where("a < b AND judged").select("host", "name")
        level = materialize(level.join(names, ["host", "name"], "left_semi").select("host", "page_id", "row", "at", "name", "judged"), "names")
        here = level.select("row", "at", F.lit(depth).alias("depth"))
        found = here if found is None else found.unionByName(here)
        if depth >= DEEP:
            break
        behind = level.select("row", (F.col("at") - depth).alias("at"), F.col("name").alias("behind"))
        level = level.join(behind, ["row", "at"]).select("host", "page_id", "row", "at", F.xxhash64("name", "behind").alias("name"), "judged")
        depth *= 2
    return found.groupBy("row", "at").agg(F.max("depth").alias("depth"))


def shared_edges(streams: DataFrame) -> DataFrame:
    """(row, at, depth): how many plain blocks ("at") of an article are the host's, at its beginning (depth -HEAD) and its end (-TAIL).

    Copies count as one article, and nearly equal blocks beside a shared side as one.
    """
    streams = streams.select(F.xxhash64("host").alias("host"), "row", "stream", "kinds", "sizes")
    found = streams.mapInArrow(_stretches, "host long, row long, side tinyint, blocks int, name long, article long, beside long")
    found = found.withColumn("key", F.xxhash64("host", "side", "name"))
    sides = found.select("host", "side", "key", "article").distinct().groupBy("host", "side", "key").agg(F.count("*").alias("articles"))
    sides = materialize(sides.where(F.col("articles") >= SEVERAL), "sides")
    of_host = sides.where(F.col("side") == WHOLE).select("host", F.col("articles").alias("all"))
    shared = sides.where(F.col("side") != WHOLE).join(of_host, "host").where(4 * F.col("articles") >= 3 * F.col("all"))
    shared = materialize(shared.select("key", "articles"), "shared")
    # only what most articles have is read again
    found = materialize(semi_reduce(found, shared.select("key"), "key", shared.count()).select("row", "side", "blocks", "key", "beside"), "edges")
    beside = found.select("key", "beside").distinct().groupBy("key").agg(F.count("*").alias("n"))
    keys = beside.where(F.col("n") >= SEVERAL).join(shared, "key").where(4 * F.col("n") >= F.col("articles")).select("key")
    keys = counted(materialize(keys, "keys"))
    found = found.join(keys, "key", "left_semi").withColumn("depth", -F.col("side").cast("int"))
    return found.groupBy("row", "depth").agg(F.max("blocks").alias("at")).select("row", "at", "depth")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row of `pages`.

    Inside a block white space becomes one space; blocks are joined in page
    order by two line feeds.  A null or empty html gives an empty text, an
    empty table an empty result, and pages of any length are read whole.  A
    page with an article returns its blocks, all of them but doubtful ones that
    are mostly links or repeated and those that at least three quarters of the
    host's articles begin or end with; other pages return their open blocks without
    what other pages of the host repeat.  Pages without a host
    (null or odd url) form one host, pages without an id are one page.
    Repeated rows, which share an id, don't count as distinct pages and are
    returned as often as they come.  Other columns are not returned.
    """
    text_batches(pages.sparkSession)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).alias("html"), host_of(url).alias("host"))
    rows = rows.withColumn("row", F.xxhash64("page_id", "url", "html"))
    kind = "page_id long, url string, row long, host string, stream string, kinds array<tinyint>, links array<float>, sizes array<int>"
    parsed = materialize(rows.mapInArrow(_parse, kind), "parsed")
    places = materialize(repeated_substrings(parsed).unionByName(shared_edges(parsed)), "places")
    found = places.groupBy("row").agg(F.collect_list(F.struct("at", "depth")).alias("found"))
    found = F.broadcast(found) if places.count() <= MAX_BROADCAST_PLACES else found
    return parsed.join(found, "row", "left").select("page_id", "url", "stream", "kinds", "links", "found").mapInArrow(_judge, "page_id long, url string, text string")
