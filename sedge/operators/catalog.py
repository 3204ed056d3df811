"""Filters, tenancy, the document catalogue, pins and write paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import upload_name
from .ranks import exact_ranks

FILTER_KEYS = ("status", "include_expired", "type", "document_id", "language", "owner_id")


def visible(filters: dict) -> Column:
    """The predicate of a filter map over document columns.

    Without a status only active documents are visible unless include_expired
    is set.  owner_id has three states: absent (no condition), null (shared
    documents only), a value (shared and that owner's).
    """
    if odd := set(filters) - set(FILTER_KEYS):
        raise ValueError(f"unknown filters: {sorted(odd)}")
    out = F.lit(True)
    if filters.get("status"):
        out = F.col("status") == filters["status"]
    elif not filters.get("include_expired"):
        out = F.col("status") == "active"
    for key, column in (("type", "type"), ("document_id", "document_id"), ("language", "language")):
        if filters.get(key):
            out = out & (F.col(column) == filters[key])
    if "owner_id" in filters:
        shared = F.col("owner_id").isNull()
        out = out & (shared | (F.col("owner_id") == filters["owner_id"]) if filters["owner_id"] else shared)
    return out


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the columns of their documents, for a search projection."""
    names = {"number": "document_number", "title": "document_title", "type": "document_type"}
    docs = documents.select("document_id", *(F.col(c).alias(names.get(c, c)) for c in documents.columns if c != "document_id"))
    return chunks.join(docs, "document_id")


def search_projection(hits: DataFrame, text_col: str = "text") -> DataFrame:
    """Text cut to 2000 characters, a quote of 600."""
    return hits.withColumn("quote", F.substring(text_col, 1, 600)).withColumn(text_col, F.substring(F.coalesce(text_col, F.lit("")), 1, 2000))


def catalog_page(documents: DataFrame, parts: DataFrame, offset: int = 0, limit: int = 50, order: tuple = (), key: str = "document_id") -> DataFrame:
    """A page of documents with their number of parts (none: 0)."""
    counts = parts.groupBy(key).agg(F.count("*").alias("parts"))
    return documents.join(counts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(0))).orderBy(*order).offset(offset).limit(limit)


def dashboard(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, active documents, chunks, the newest document."""
    docs = documents.agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "active").alias("active"), F.max_by("document_id", F.struct("updated_at", "document_id")).alias("newest")
    )
    return docs.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))  # two rows in all


def pins(pinned: DataFrame, documents: DataFrame, most: int = 50) -> DataFrame:
    """Each user's pinned documents, newest first; the first pin of a document counts."""
    once = pinned.groupBy("user_id", "document_id").agg(F.min("created_at").alias("created_at"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("document_id")))
    return once.join(documents, "document_id").withColumn("place", place).where(F.col("place") <= most)


def suggestions(documents: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The first documents whose number or title contains the query."""
    low = query.lower()
    hit = F.lower("number").contains(low) | F.lower("title").contains(low)
    return documents.where(hit).orderBy("document_id").limit(limit)


def unique_numbers(documents: DataFrame, order: tuple = ("document_id",)) -> DataFrame:
    """Within an owner, later documents of a number get a suffix of their checksum.

    The given columns are written once to be ranked: leave texts out.
    """
    suffix = F.concat("number", F.lit(" ("), F.substring("checksum", 1, 6), F.lit(")"))
    return exact_ranks(documents, ["owner_id", "number"], list(order), "nth").withColumn("unique_number", F.when(F.col("nth") > 1, suffix).otherwise(F.col("number"))).drop("nth")


def new_rows(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known; a null key is always new."""
    return incoming.join(known.select(*keys).distinct(), keys, "left_anti")


def successors(documents: DataFrame) -> DataFrame:
    """Documents with the number and status of the one that replaces them."""
    next_ = documents.select(F.col("document_id").alias("replaced_by_id"), F.col("number").alias("successor"), F.col("status").alias("successor_status"))
    return documents.join(next_, "replaced_by_id", "left")


def delete_documents(table: DataFrame, ids: DataFrame, allowed: Column | None = None) -> DataFrame:
    """What is left of a table without the documents of `ids` (cascade: call it for each table)."""
    if allowed is not None:
        ids = ids.join(table.where(allowed).select("document_id").distinct(), "document_id", "left_semi")
    return table.join(ids.select("document_id").distinct(), "document_id", "left_anti")


def by_ids(chunks: DataFrame, requested: DataFrame, most: int = 5) -> DataFrame:
    """The requested chunks of each query (query_id, ids) in the order asked, unknown ids left out."""
    asked = requested.select("query_id", F.posexplode(F.slice("ids", 1, most)).alias("pos", "id"))
    return asked.join(chunks, "id").orderBy("query_id", "pos")


def without_answered(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Hits to show beside an answer: a grounded one already shows the first."""
    said = answers.select("query_id", "is_grounded")
    shown = (F.col("rank") > 1) | ~F.coalesce("is_grounded", F.lit(False))
    return hits.join(said, "query_id", "left").where(shown).drop("is_grounded")


def chunk_page(chunks: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a listing of chunks by page and clause; clauses sort as text ("5.10" before "5.9")."""
    return chunks.orderBy("page", F.col("paragraph").asc_nulls_last(), "id").offset(offset).limit(limit)


def not_noise(text: Column, kind: Column, paragraph: Column, least: int = 25, least_numbered: int = 15) -> Column:
    """Tables, numbered chunks of 15 characters and others of 25 are worth keeping."""
    size = F.length(F.trim(text))
    return (kind == "table") | (size >= F.when(paragraph.isNotNull(), least_numbered).otherwise(least))


def post_filter(hits: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Hits that are already cut to the best k, by status and by the upper-case prefix of their number."""
    out = hits if status is None else hits.where(F.col("status") == status)
    return out if kind is None else out.where(F.startswith(F.upper("number"), F.upper(F.lit(kind))))


def history_filter(history: DataFrame, typed: str, keys: tuple[str, ...] = ("user_id",), most: int = 8) -> DataFrame:
    """The newest entries (keys, text, ts) of each history that contain what is typed, in any case."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), "text"))
    return history.where(F.contains(F.lower("text"), F.lower(F.lit(typed)))).withColumn("place", place).where(F.col("place") <= most)


def part_total(documents: DataFrame) -> DataFrame:
    """One row: the sum of the documents' parts, null counted as 0."""
    return documents.agg(F.coalesce(F.sum(F.coalesce("parts", F.lit(0))), F.lit(0)).cast("long").alias("total"))


def newest(rows: DataFrame, time: str, key: str, most: int = 20) -> DataFrame:
    """The newest rows, ties to the larger key."""
    return rows.orderBy(F.desc(time), F.desc(key)).limit(most)


def corpora(**sources: DataFrame) -> DataFrame:
    """One corpus of several, each row with the name of its source."""
    named = [df.withColumn("corpus", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def successors_by_number(documents: DataFrame, replaced: DataFrame) -> DataFrame:
    """Replaced numbers (number, by_number) with the successor's id and status; of equal numbers the first document counts."""
    first = documents.groupBy("number").agg(F.min("document_id").alias("successor_id"), F.min_by("status", "document_id").alias("successor_status"))
    return replaced.join(first.withColumnRenamed("number", "by_number"), "by_number", "left")


def accepted_uploads(files: DataFrame, limit: int = 100 * 1024 * 1024) -> DataFrame:
    """Uploads (upload_id, name, size) of PDF names within the size limit, under free names.

    Names are sanitised; of equal ones the later uploads get _1, _2 and so on
    before the extension.
    """
    safe = upload_name(F.col("name"))
    kept = files.where((F.col("size") <= limit) & F.lower(F.trim("name")).endswith(".pdf")).withColumn("file", safe)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    kept = exact_ranks(kept, ["file"], ["upload_id"], "nth").withColumn("nth", F.col("nth") - 1)
    return kept.withColumn("file", F.when(F.col("nth") == 0, F.col("file")).otherwise(F.concat(stem, F.lit("_"), F.col("nth").cast("string"), F.lit(".pdf")))).drop("nth")
