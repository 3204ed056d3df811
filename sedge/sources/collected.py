"""Links, statuses and document rows of stored listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

LINK = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, pos, href, title, target) of every link of a page, in order."""
    hrefs = F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))
    titles = F.regexp_extract_all(html_col, F.lit(LINK), F.lit(2))
    rows = pages.select(F.col(url_col).alias("url"), F.posexplode(F.arrays_zip(hrefs.alias("href"), titles.alias("title"))).alias("pos", "x"))
    rows = rows.select("url", "pos", "x.href", F.trim(F.regexp_replace("x.title", "<[^>]*>", "")).alias("title"))
    return rows.withColumn("target", tx.join_url(F.col("url"), F.col("href")))


def listing(pages: DataFrame, pattern: str, keywords: tuple[str, ...] = (), least_title: int = 5) -> DataFrame:
    """Document links of listing pages: hrefs with `pattern`, titles long enough and with a keyword.

    Of links to one target the first counts.
    """
    rows = links(pages).where(F.col("href").contains(pattern) & (F.length("title") >= least_title))
    if keywords:
        rows = rows.where(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.lower(F.col("title")).contains(k)))
    first = F.row_number().over(Window.partitionBy("target").orderBy("url", "pos"))
    rows = rows.withColumn("n", first).where("n = 1").drop("n")
    return rows.withColumn("number", tx.document_number(F.col("title"))).withColumn("status", tx.status_from_text(F.col("title")))


def pdf_link(pages: DataFrame) -> DataFrame:
    """(url, pdf): the first link to a .pdf, else the first that says скачать."""
    rows = links(pages)
    is_pdf = F.lower("href").contains(".pdf")
    named: Column = F.lower("title").contains("скачать")
    best = F.min_by("target", F.struct((~is_pdf).cast("int").alias("k"), "pos"))
    return rows.where(is_pdf | named).groupBy("url").agg(best.alias("pdf"))


def pages_from_binary(files: DataFrame) -> DataFrame:
    """(ordinal, path, checksum) of a binaryFile scan: file order fixes the document's ordinal.

    Only paths and checksums are numbered, never contents; the paths of each
    folder's share are counted first, so no task holds the whole listing.
    """
    named = files.select("path", F.sha2("content", 256).alias("checksum")).withColumn("share", F.regexp_extract("path", r"^(.*/)", 1))
    sizes = named.groupBy("share").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("share", ahead.alias("ahead"))  # a row for each folder
    within = F.row_number().over(Window.partitionBy("share").orderBy("path")) - 1
    return named.join(sizes, "share").select((F.col("ahead") + within).alias("ordinal"), "path", "checksum")


def with_metadata(documents: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Documents (stem, number) with a sidecar's (stem, number, title), which wins."""
    side = sidecar.select("stem", F.col("number").alias("side_number"), F.col("title").alias("side_title"))
    out = documents.join(side, "stem", "left")
    return out.withColumn("number", F.coalesce("side_number", "number")).withColumn("title", F.coalesce("side_title", "title", "stem")).drop("side_number", "side_title")


def page_texts(blocks: DataFrame, plain: DataFrame, share: float = 0.9, least: int = 40) -> DataFrame:
    """(doc_id, page, text, has_text, x0, y0, x1, y1) of extracted pages.

    blocks: doc_id, page, x0, y0, x1, y1, text; plain: doc_id, page, text.
    Blocks are read in rows of 20 points, from the left; their text is taken
    if it has more than `share` of the plain text's length, or the plain text
    is empty.  The box is that of the first block.
    """
    order = F.struct(F.bround(F.col("y0") / 20).alias("row"), "x0", "y0", "text")
    box = F.struct("x0", "y0", "x1", "y1")
    kept = blocks.where(F.trim("text") != "")
    read = F.transform(F.sort_array(F.collect_list(order)), lambda b: b["text"])
    rows = kept.groupBy("doc_id", "page").agg(F.array_join(read, "\n").alias("by_block"), F.min_by(box, order).alias("box"))
    both = plain.withColumnRenamed("text", "plain").join(rows, ["doc_id", "page"], "full_outer")
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    text = F.when((size("by_block") > size("plain") * share) | (size("plain") == 0), F.coalesce("by_block", F.lit(""))).otherwise(F.col("plain"))
    out = both.select("doc_id", "page", text.alias("text"), "box.*")
    return out.withColumn("has_text", F.length(F.trim("text")) > least)
