"""Segmenting documents into clause-level chunks.

Lines get their kind from patterns, segments are islands between boundaries
(a running sum), chapters carry forward over pages (a window), short chunks
find the chunk they join by another window, and only the sliding window over
long segments, each of which begins where the one before it ended, runs in
Python, for long segments alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

#: Characters of a chunk, and by how many neighbouring windows overlap.
MAX_CHARS, OVERLAP = 2800, 600
#: Shorter chunks join their predecessor; shorter ones without / with a clause number are noise.
SHORT, NOISE, NOISE_NUMBERED = 100, 25, 15


def lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, kind): the lines of pages (doc_id, page, text) that aren't blank."""
    out = pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    out = out.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")
    return out.withColumn("kind", tx.line_kind(F.col("text")))


def segments(pages: DataFrame) -> DataFrame:
    """(doc_id, page, segment, chapter, paragraph, type, text) in reading order.

    A segment never crosses a page.  Captions of tables stand alone under the
    clause before them, chapter lines only set the chapter.
    """
    rows = lines(pages)
    page = Window.partitionBy("doc_id", "page").orderBy("line")
    so_far = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    doc = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after_gap = F.coalesce(F.lag("kind").over(page), F.lit("none")).isin("none", "table", "chapter")
    starts = F.col("kind").isin("paragraph", "table") | ((F.col("kind") == "text") & after_gap)
    rows = rows.withColumn("starts", starts).withColumn("segment", F.sum(F.col("starts").cast("int")).over(so_far))
    rows = rows.withColumn("chapter", F.last(F.when(F.col("kind") == "chapter", F.substring("text", 1, 250)), True).over(doc))
    inline = F.nullif(F.regexp_extract("text", r"^.*?(\d+\.\d+(?:\.\d+)*)\s+[А-ЯA-Z]", 1), F.lit(""))
    number = F.when(F.col("kind") == "paragraph", F.regexp_extract("text", tx.PARAGRAPH, 1)).otherwise(inline)
    named = F.when(F.col("starts") & (F.col("kind") != "table"), F.struct(number.alias("p")))
    above = F.last(named, True).over(so_far)["p"]
    caption = F.concat(F.lit("Таблица "), F.regexp_extract("text", tx.TABLE, 1))
    rows = rows.withColumn("paragraph", F.when(F.col("kind") == "table", F.coalesce(above, caption)).otherwise(number))
    part = rows.where("kind <> 'chapter'").groupBy("doc_id", "page", "segment")
    first = lambda c: F.min_by(c, "line").alias(c)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    kind = F.when(F.min_by("kind", "line") == "table", "table").otherwise("paragraph")
    return part.agg(first("chapter"), first("paragraph"), kind.alias("type"), joined.alias("text"))


_SENTENCE_END = re.compile(r"[.!?;](?= )")


def split_long(text: str, size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Windows of at most `size` characters that overlap.

    A window ends at its last sentence end beyond 55 % of its size, else at
    its last blank beyond 80 %, else where it is full.
    """
    if not 0 <= overlap < size * 0.55:
        raise ValueError("the overlap must be smaller than any window")
    if len(text) <= size:
        return [text]
    sentences = [m.end() for m in _SENTENCE_END.finditer(text)]
    blanks = [m.start() for m in re.finditer(" ", text)]

    def last(places: list[int], low: float, high: int) -> int | None:
        """The last of `places` in low < place < high."""
        i = bisect_right(places, high - 1)
        return places[i - 1] if i and places[i - 1] > low else None

    spans, begin = [], 0
    while not spans or spans[-1][1] < len(text):
        full = begin + size
        end = len(text)
        if full < end:
            end = last(sentences, begin + size * 0.55 + 1, full) or last(blanks, begin + size * 0.8, full) or full
        spans.append((begin, end))
        begin = end - overlap
    return [text[a:b].strip() for a, b in spans]


@F.pandas_udf(T.ArrayType(T.StringType()))
def windows(texts: pd.Series) -> pd.Series:
    """Sliding windows of each text."""
    return texts.map(lambda t: split_long(t) if t is not None else [])


def merged(parts: DataFrame) -> DataFrame:
    """Short chunks of a clause join the chunk before them; noise goes.

    What a chunk meets is the last one before it that is not noise: whether
    that one stands alone or has joined another of its clause, clause and kind
    are the same, so a window finds them and no step waits for another.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "segment", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered, table = F.col("paragraph").isNotNull(), F.col("type") == "table"
    lasting = table | (F.length(F.trim("text")) >= F.when(numbered, NOISE_NUMBERED).otherwise(NOISE))
    rows = parts.withColumn("lasting", lasting)
    rows = rows.withColumn("last", F.last(F.when(F.col("lasting"), F.struct("paragraph", "type")), True).over(before))
    joins = (F.length("text") < SHORT) & (F.length("text") > 0) & ~table & (F.col("last.type") != "table") & (F.col("last.paragraph") == F.col("paragraph"))
    rows = rows.withColumn("joins", F.coalesce(joins, F.lit(False))).where("joins or lasting")
    rows = rows.withColumn("chunk", F.sum((~F.col("joins")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.struct("page", "segment", "part")
    head = lambda c: F.min_by(c, place).alias(c)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("place"), "text"))), lambda x: x["text"]), " ")
    out = rows.groupBy("doc_id", "chunk").agg(*(head(c) for c in ("page", "chapter", "paragraph", "type")), text.alias("text"))
    return out.withColumn("ordinal", (F.col("chunk") - 1).cast("int")).drop("chunk")


def chunk(pages: DataFrame) -> DataFrame:
    """(doc_id, page, chapter, paragraph, type, text, ordinal, token_count) of pages."""
    rows = segments(pages)
    long = F.when((F.length("text") > MAX_CHARS) & (F.col("type") != "table"), F.col("text"))
    rows = rows.withColumn("windows", windows(long))
    parts = F.when(F.size("windows") > 0, F.col("windows")).otherwise(F.array("text"))
    rows = rows.select("doc_id", "page", "segment", "chapter", "paragraph", "type", F.posexplode(parts).alias("part", "text"))
    return merged(rows).withColumn("token_count", tx.token_count(F.col("text")))


def register(spark) -> None:
    """Make chunk_text(text) and chunk_segments(TABLE(...)) known to SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("chunk_segments", ChunkSegments)


@F.udtf(returnType="ordinal: int, text: string")
class ChunkText:
    """chunk_text(text): the overlapping windows of a plain text."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_long(text or ""))


@F.udtf(returnType="doc_id: long, ordinal: int, page: int, chapter: string, paragraph: string, type: string, text: string")
class ChunkSegments:
    """chunk_segments(TABLE(segments) PARTITION BY doc_id ORDER BY (page, segment)): the chunks of each document.

    The table has the columns of `segments`.  A document's segments come in
    order, and only its last chunk is held until the next one begins.
    """

    def __init__(self) -> None:
        self.open: dict | None = None
        self.ordinal = 0

    def _closed(self) -> Iterator[tuple]:
        if self.open is not None:
            c = self.open
            yield c["doc_id"], self.ordinal, c["page"], c["chapter"], c["paragraph"], c["type"], " ".join(c["texts"])
            self.ordinal += 1

    def eval(self, row: T.Row) -> Iterator[tuple]:
        table = row["type"] == "table"
        for text in [row["text"]] if table else split_long(row["text"]):
            last = self.open
            if last and 0 < len(text) < SHORT and row["paragraph"] and last["paragraph"] == row["paragraph"] and not table and last["type"] != "table":
                last["texts"].append(text)
            elif table or len(text.strip(" ")) >= (NOISE_NUMBERED if row["paragraph"] is not None else NOISE):
                yield from self._closed()
                self.open = {c: row[c] for c in ("doc_id", "page", "chapter", "paragraph", "type")} | {"texts": [text]}

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed()


def scan_flags(pages: DataFrame) -> DataFrame:
    """(doc_id, is_scanned): under half of the pages have text, or under 80 characters a page."""
    has_text = (F.length(F.trim("text")) > 40).cast("int")
    return pages.groupBy("doc_id").agg(((F.avg(has_text) < 0.5) | (F.avg(F.length(F.trim("text"))) < 80)).alias("is_scanned"))
