"""Page archives: WARC records of pages, each distinct payload stored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import warc
from .scratch import counted, materialize, text_batches

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """The base32 letters of a hexadecimal digest of a multiple of 20 bits (SHA-1: 160)."""
    letters = F.lit(_ALPHABET)
    five = lambda i: F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
    place = lambda bits, k: (F.shiftright(bits, 15 - 5 * k).bitwiseAND(31) + 1).cast("int")
    return F.concat(*(F.substring(letters, place(five(i), k), F.lit(1)) for i in range(8) for k in range(4)))


def _page_id(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), _page_id(page_id), F.lit(":"), digest, F.lit(">"))


def page_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows for the WARC writer: a response or a revisit for every row of `pages`.

    Of rows with equal payloads (html in UTF-8; null: empty) of at least
    `min_bytes`, that with the greatest id is the response; a null id is less
    than all others.  Of repeated rows with one id, that with the least url
    (null first) is the response, once.  Payloads of revisits are left out.
    Payloads that only one row has are never shuffled; equal ones are known by
    SHA-1 and size, and their few facts go to the rows where they are counted.
    """
    text_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    by_page = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size", "page_id").agg(F.count("*").alias("copies"))
    one = F.max(F.struct("page_id", "copies")).alias("one")
    groups = by_page.groupBy("digest", "size").agg(one, F.sum("copies").alias("rows")).where("rows > 1")
    shared = materialize(groups.select("digest", "size", F.col("one.page_id").alias("keeper"), F.col("one.copies").alias("tied"), F.lit(True).alias("known")), "payloads")
    several = shared.where("tied > 1").limit(1).count()
    marked = rows.join(counted(shared), ["digest", "size"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    keeps = ~F.col("known") | F.col("page_id").eqNullSafe(F.col("keeper"))
    marked = marked.withColumn("response", keeps)
    out = marked
    if several:  # repeated ids among the responses: rows that are equal are counted, one of the least url stays
        tied = F.col("response") & (F.coalesce("tied", F.lit(1)) > 1)
        same = marked.where(tied).groupBy("digest", "size", "page_id", "url").agg(F.count("*").alias("copies"), F.first("html").alias("html"))
        first = F.row_number().over(Window.partitionBy("digest", "size").orderBy("url")) == 1
        same = same.withColumn("first", first).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        same = same.withColumns({"response": F.col("first") & (F.col("copy") == 1), "keeper": F.col("page_id"), "known": F.lit(True), "tied": F.lit(1).cast("long")})
        out = marked.where(~tied).unionByName(same.select(*marked.columns))
    digest = base32(F.col("digest"))
    return out.select(
        F.when(F.col("response"), "response").otherwise("revisit").alias("record_type"),
        F.when(F.col("response"), _record_id(F.col("page_id"), digest)).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(F.col("response"), F.col("html").cast("binary")).alias("payload"),
        F.concat(F.lit("sha1:"), digest).alias("payload_digest"),
        F.col("size").alias("payload_bytes"),
        F.when(~F.col("response"), _record_id(F.col("keeper"), digest)).alias("refers_to"),
        F.create_map(F.lit("X-Page-Id"), _page_id(F.col("page_id"))).alias("headers"),
    )


def write_archive(records: DataFrame, path: str, level: int = 6) -> None:
    """Append WARC files with `records` (columns of warc.SCHEMA) below `path`."""
    warc.register(records.sparkSession)
    records.write.format("warc").mode("append").option("level", str(level)).save(path)


def read_archive(spark: SparkSession, path: str, columns: str = warc.SCHEMA) -> DataFrame:
    """The records below `path`; only the given columns (a schema) are parsed, and blocks only for `payload`."""
    warc.register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of pages.

    Responses are measured by the payload that the archive holds; revisits by
    their headers, in a scan that steps over all other records.
    """
    page = F.col("headers")["x-page-id"]
    whole = read_archive(spark, path, "record_type string, headers map<string,string>, payload binary").where("record_type = 'response'")
    whole = whole.select(page.alias("page"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers"))
    heads = read_archive(spark, path, "record_type string, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>").where("record_type = 'revisit'")
    refers = F.regexp_extract("refers_to", r"^<urn:page:(-?\d*):", 1)
    heads = heads.select(page.alias("page"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", refers.alias("refers"))
    number = lambda c: F.when(c != "", c).cast("long")
    both = whole.unionByName(heads)
    return both.select(number(F.col("page")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers")).alias("refers_to"))
