"""The engine over one corpus: index once, then search, ask and report.

Queries are a table (query_id, text); a single question is a batch of one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.profiles import RUSSIAN, Profile
from .functions.vectors import centroid
from .operators import answers, catalog, dense, expansion, fusion, grams, lexical
from .sources import artifacts
from .sources.staging import staged

#: Hits of a query: by default, by default in deep mode of the client, at most for a plain link.
TOP, TOP_DEEP, TOP_MOST = 10, 20, 20


def capped(top: int | None, mode: str = "fast", client: bool = False) -> int:
    """The number of hits that a link may ask for: the default of the mode, or what is asked up to the cap."""
    if top is None:
        return TOP_DEEP if client and mode == "deep" else TOP
    return max(1, min(top, TOP_MOST))


@dataclass
class Engine:
    """Documents, their chunks and the index tables of the chunks.

    documents: document_id, number, title, type, status, language, owner_id.
    chunks: id, document_id, paragraph, page, text.  vectors: id, v (optional).
    """

    documents: DataFrame
    chunks: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    vectors: DataFrame | None = None
    profile: Profile = RUSSIAN

    @classmethod
    def index(cls, documents: DataFrame, chunks: DataFrame, path: str, vectors: DataFrame | None = None, profile: Profile = RUSSIAN) -> Engine:
        """Write the index of `chunks` below `path` and open it."""
        artifacts.write_index(chunks, profile, path, vectors)
        return cls.open(documents.sparkSession, documents, path, vectors, profile)

    @classmethod
    def open(cls, spark: SparkSession, documents: DataFrame, path: str, vectors: DataFrame | None = None, profile: Profile = RUSSIAN) -> Engine:
        """Open a written index; `vectors` (id, v) replace the quantised ones that it holds."""
        held = artifacts.read_index(spark, path)
        return cls(documents, profile=profile, **(held if vectors is None else held | {"vectors": vectors}))

    def search(self, queries: DataFrame, vectors: DataFrame | None = None, mode: str = "fast", filters: dict | None = None, top: int = 10) -> DataFrame:
        """Fused hits of each query with the columns of their documents.

        Full text asks for all terms of a query; deep also asks each of up to
        three synonym variants, every one with its own limit, and keeps a
        row's best score.  A query without a match falls back to substrings,
        then (without dense hits as well) to trigrams.  `vectors` (query_id,
        qv) are embeddings, one for each variant that has one: their centroid
        is searched.  Filters hold before candidates are cut.
        """
        deep = mode == "deep"
        limit, pool = (80, 40) if deep else (50, 30)
        seen = catalog.with_documents(self.chunks, self.documents).where(catalog.visible(filters or {}))
        ids = seen.select("id")
        plain = queries.select("query_id", tx.normalize_query(F.col("text")).alias("text"))
        variants = expansion.expand(plain, self.profile.synonyms, 3 if deep else 1)
        said = variants.groupBy("query_id").agg(F.collect_list(F.when(F.col("pos") > 0, F.col("variant"))).alias("more"), F.count("*").alias("n"))
        plain = plain.join(said, "query_id").withColumn("words", grams.fallback_words(F.col("text"), F.col("more")))
        keyed = variants.select("query_id", F.struct("query_id", "pos").alias("key"), "variant")
        terms = lexical.query_terms(keyed.select(F.col("key").alias("query_id"), "variant"), self.profile, "variant")
        scored = lexical.bm25(terms, self.postings, self.lengths, self.stats).withColumn("score", F.round("score", 6))
        scored = scored.join(lexical.match_all(terms, self.postings), ["query_id", "id"], "left_semi").join(ids, "id", "left_semi")
        scored = lexical.top_per_query(scored, limit).select(F.col("query_id.query_id").alias("query_id"), "id", "score", "rank")
        each = F.greatest(F.lit(20), F.floor(F.lit(limit) / F.col("n")) + 5) if deep else F.lit(limit)
        scored = scored.join(plain.select("query_id", "n"), "query_id").where(F.col("rank") <= each)
        fts = lexical.top_per_query(scored.groupBy("query_id", "id").agg(F.max("score").alias("score")), limit).drop("rank")
        fts = staged(fts, "fts")  # a few rows of each query that every later step asks for
        near = None
        if vectors is not None and self.vectors is not None:
            mean = centroid(vectors, ["query_id"], "qv").select("query_id", F.col("centroid").alias("qv"))
            near = dense.cosine_top(mean, self.vectors.join(ids, "id", "left_semi"), limit, places=12)
            near = staged(near.drop("rank"), "near")
        lists = staged(grams.cascade(fts, seen.select("id", "text"), plain, near, limit), "lists")
        fused = fusion.server_fusion(lists.drop("source"), fts.limit(0) if near is None else near, pool, top)
        fused = fused.join(lists.select("query_id", "id", "source"), ["query_id", "id"], "left")
        vec = F.when(F.col("source") == "trigram", F.coalesce("vec", F.lit(0.0))).otherwise(F.col("vec"))
        return catalog.search_projection(fused.withColumn("vec", vec).join(seen, "id"))

    def ask(self, queries: DataFrame, vectors: DataFrame | None = None, mode: str = "fast", filters: dict | None = None) -> DataFrame:
        """Extractive answers with the guard's verdict; unsure ones say so."""
        hits = self.search(queries, vectors, mode, filters, 5 if mode == "deep" else 3)
        guard = fusion.server_guard(hits, self.stats)
        sure = hits.join(guard.where("NOT low_confidence"), "query_id", "left_semi")
        shown = sure.select("query_id", "rank", F.col("document_number").alias("number"), F.col("document_title").alias("title"), "paragraph", "page", "text", "status")
        out = answers.extractive_answers(queries, shown, F.current_date())
        out = out.join(guard, "query_id", "left").withColumn("low_confidence", F.coalesce("low_confidence", F.lit(True)))
        return out.join(fusion.messages(queries, hits, guard), "query_id", "left")

    def statistics(self) -> DataFrame:
        return catalog.dashboard(self.documents, self.chunks)
