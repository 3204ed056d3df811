"""More named queries: listings, histories, collected pages, answers held against their hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine, capped
from ..functions import text as tx
from ..functions.automaton import highlight_each
from ..functions.profiles import LATIN
from ..operators import answers, catalog, expansion, fusion, lexical, usage
from ..operators.paging import Listing
from ..sources import collected
from ..sources.segments import SegmentStore
from ..sources.staging import shared_path
from .catalogue import _DENSE, _INDEX, _SQUEEZE, QUERIES, _asked, _bm25, _near, _query, _quotes, _sql_expand, _sql_label, _tokens
from .tables import DOCUMENTS_SQL, LINES_SQL, LOG_SQL, documents, lines, query_log, table

# ---- search ----------------------------------------------------------------


@_query(
    f"""WITH b AS (SELECT query_id, lower(text) AS text FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in QUERIES)}) AS q(query_id, text)),
v AS ({_sql_expand(True, "client")}),
term AS (SELECT DISTINCT query_id, pos, t AS term FROM v, unnest({_tokens("variant")}) AS x(t)),
tok AS (SELECT doc_id AS id, {_tokens("text")} AS tokens FROM documents),
len_ AS (SELECT id, len(tokens) AS dl FROM tok),
stat AS (SELECT count(*) AS n, round(avg(dl), 2) AS avgdl FROM len_),
post AS (SELECT t AS term, id, count(*) AS tf FROM tok, unnest(tokens) AS x(t) WHERE t IN (SELECT term FROM term) GROUP BY t, id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (
  SELECT query_id, pos, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (CASE WHEN dl = 0 THEN avgdl ELSE dl END) / avgdl)))), 6) AS score
  FROM term JOIN post USING (term) JOIN df USING (term) JOIN len_ USING (id), stat GROUP BY query_id, pos, id),
{_DENSE},
l AS (
  SELECT query_id, id, score AS bm, NULL::DOUBLE AS vec, row_number() OVER (PARTITION BY query_id, pos ORDER BY score DESC, id) AS r FROM bm
  UNION ALL SELECT query_id, id, NULL, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM near),
u AS (SELECT query_id, id, max(bm) AS bm, max(vec) AS vec, round(sum(1 / (60 + r)), 9) AS rrf FROM l GROUP BY query_id, id),
t AS (SELECT *, max(rrf) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM u QUALIFY rank <= 20),
p AS (SELECT *, CAST(greatest(10, least(98, floor(round(10 + 88 * (0.6 * rrf / best + 0.4 * coalesce(vec, 0)), 6) + 0.5))) AS INT) AS percent FROM t)
SELECT query_id, id, bm, vec, round(rrf, 6) AS rrf, percent, {_sql_label(85, 70, 55)} AS label, CAST(rank AS INT) AS rank FROM p"""
)
def rrf_client_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's deep search: a lexical list for each variant, 20 hits."""
    asked = _asked(spark).withColumn("text", F.lower("text"))
    variants = expansion.expand(asked, LATIN.synonyms, first_only=True)
    keyed = variants.select(F.struct("query_id", "pos").alias("query_id"), F.col("variant").alias("text"))
    terms = lexical.query_terms(keyed, LATIN)
    counted = lexical.counted(lexical.occurrences(table(spark, sf_dir, "documents"), LATIN, "doc_id"), terms)
    sizes = lexical.lengths(counted)
    scored = lexical.bm25(terms, lexical.postings(counted), sizes, lexical.statistics(sizes))
    scored = scored.select("query_id.query_id", F.col("query_id.pos").alias("variant"), "id", F.round("score", 6).alias("score"))
    out = fusion.client_fusion(scored, _near(spark, sf_dir), top=20)
    return out.withColumns({"rrf": F.round("rrf", 6), "rank": F.col("rank").cast("int")})


@_query(
    f"""WITH {_INDEX}, {DOCUMENTS_SQL},
want AS (SELECT query_id, count(*) AS n FROM term GROUP BY query_id),
held AS (SELECT query_id, id FROM (SELECT query_id, id, count(*) AS n FROM term JOIN post USING (term) GROUP BY query_id, id) JOIN want USING (query_id, n)),
seen AS (SELECT * FROM docs WHERE status = 'active' AND (owner_id = 'owner3' OR owner_id IS NULL)),
fts AS (SELECT query_id, id, score, 'fts' AS source FROM bm JOIN held USING (query_id, id) JOIN seen ON document_id = id),
word AS (SELECT * FROM (VALUES (1, 'the'), (1, 'tion'), (1, 'and'), (1, 'inthe'), (2, 'une'), (2, 'eau'), (2, 'que'), (2, 'les'), (3, 'verkeit'), (3, 'der'), (3, 'und'), (3, 'schst')) AS w(query_id, word)),
like_ AS (SELECT DISTINCT query_id, document_id AS id, 0.5::DOUBLE AS score, 'ilike' AS source FROM seen JOIN word ON contains(lower(text), word) WHERE query_id NOT IN (SELECT query_id FROM fts)),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT * FROM fts UNION ALL SELECT * FROM like_) QUALIFY r <= 50),
f AS (SELECT query_id, id, score, source, round(1 / (60 + r) + 0.15 * score / max(score) OVER (PARTITION BY query_id), 9) AS rrf FROM a),
g AS (SELECT *, round(rrf / max(rrf) OVER (PARTITION BY query_id), 9) AS fusion FROM f)
SELECT query_id, id, round(score, 4) AS bm, CAST(greatest(10, least(98, floor(round(fusion * 100, 6)))) AS INT) AS percent, source,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, id) AS INT) AS rank FROM g QUALIFY rank <= 10"""
)
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine itself over the documents as chunks: index, then search with filters."""
    docs = documents(spark, sf_dir)
    chunks = docs.select(F.col("document_id").alias("id"), "document_id", "text", F.lit(None).cast("string").alias("paragraph"), F.lit(1).alias("page"))
    engine = Engine.index(docs.drop("text", "checksum"), chunks, shared_path(spark, "index"), profile=LATIN)
    hits = engine.search(_asked(spark), filters={"owner_id": "owner3"})
    return hits.select("query_id", "id", F.round("bm", 4).alias("bm"), "percent", "source", F.col("rank").cast("int").alias("rank"))


@_query(
    rf"""WITH {_INDEX.split("tok AS", 1)[0].rstrip().rstrip(",")}, {DOCUMENTS_SQL},
b AS (SELECT query_id, trim(regexp_replace(regexp_replace(lower(text), '[^\w\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM asked),
v AS ({_sql_expand(False, "server")}),
each_ AS (SELECT query_id, count(*) AS n, greatest(20, 80 // count(*) + 5) AS most FROM v GROUP BY query_id),
term AS (SELECT DISTINCT query_id, pos, t AS term FROM v, unnest({_tokens("variant")}) AS x(t)),
tok AS (SELECT doc_id AS id, {_tokens("text")} AS tokens FROM documents),
len_ AS (SELECT id, len(tokens) AS dl FROM tok),
stat AS (SELECT count(*) AS n, round(avg(dl), 2) AS avgdl FROM len_),
post AS (SELECT t AS term, id, count(*) AS tf FROM tok, unnest(tokens) AS x(t) WHERE t IN (SELECT term FROM term) GROUP BY t, id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (
  SELECT query_id, pos, id, count(*) AS found, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (CASE WHEN dl = 0 THEN avgdl ELSE dl END) / avgdl)))), 6) AS score
  FROM term JOIN post USING (term) JOIN df USING (term) JOIN len_ USING (id), stat GROUP BY query_id, pos, id),
want AS (SELECT query_id, pos, count(*) AS wanted FROM term GROUP BY query_id, pos),
seen AS (SELECT * FROM docs WHERE status = 'active' AND (owner_id = 'owner3' OR owner_id IS NULL)),
one AS (
  SELECT query_id, pos, id, score, row_number() OVER (PARTITION BY query_id, pos ORDER BY score DESC, id) AS r
  FROM bm JOIN want USING (query_id, pos) JOIN seen ON document_id = id WHERE found = wanted),
fts AS (SELECT query_id, id, max(score) AS score FROM one JOIN each_ USING (query_id) WHERE r <= least(most, 80) GROUP BY query_id, id),
own AS (SELECT query_id, list_slice(list_filter(string_split(text, ' '), lambda w: len(w) >= 3), 1, 4) AS words FROM b),
more AS (
  SELECT query_id, unnest(list_filter(string_split(variant, ' '), lambda w: len(w) >= 3)) AS w, pos, generate_subscripts(list_filter(string_split(variant, ' '), lambda w: len(w) >= 3), 1) AS i FROM v WHERE pos > 0),
extra AS (SELECT query_id, w, min(pos * 1000 + i) AS place FROM more JOIN own USING (query_id) WHERE NOT list_contains(words, w) GROUP BY query_id, w),
word AS (SELECT query_id, unnest(list_slice(list_concat(words, coalesce((SELECT list(w ORDER BY place) FROM extra e WHERE e.query_id = own.query_id), [])), 1, 6)) AS word FROM own),
like_ AS (SELECT DISTINCT query_id, document_id AS id, 0.5::DOUBLE AS score FROM seen JOIN word ON contains(lower(text), word) WHERE query_id NOT IN (SELECT query_id FROM fts)),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT *, 'fts' AS source FROM fts UNION ALL SELECT *, 'ilike' FROM like_) QUALIFY r <= 80),
f AS (SELECT query_id, id, score, source, round(1 / (60 + r) + 0.15 * score / max(score) OVER (PARTITION BY query_id), 9) AS rrf FROM a),
g AS (SELECT *, round(rrf / max(rrf) OVER (PARTITION BY query_id), 9) AS fusion FROM f)
SELECT query_id, id, round(score, 4) AS bm, CAST(greatest(10, least(98, floor(round(fusion * 100, 6)))) AS INT) AS percent, source,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, id) AS INT) AS rank FROM g QUALIFY rank <= 20"""
)
def engine_deep_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep mode: each synonym variant asks for its own terms under its own limit; more hits than the cap are asked for."""
    docs = documents(spark, sf_dir)
    chunks = docs.select(F.col("document_id").alias("id"), "document_id", "text", F.lit(None).cast("string").alias("paragraph"), F.lit(1).alias("page"))
    engine = Engine.index(docs.drop("text", "checksum"), chunks, shared_path(spark, "index"), profile=LATIN)
    hits = engine.search(_asked(spark), mode="deep", filters={"owner_id": "owner3"}, top=capped(500))
    return hits.select("query_id", "id", F.round("bm", 4).alias("bm"), "percent", "source", F.col("rank").cast("int").alias("rank"))


@_query(
    f"""WITH {_INDEX}, {DOCUMENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 10)
SELECT query_id, id, CAST(rank AS INT) AS rank, number, status FROM r JOIN docs ON document_id = id WHERE status = 'active' AND upper(number) LIKE 'SRC1%'"""
)
def client_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.top_per_query(_bm25(spark, sf_dir), 10).join(documents(spark, sf_dir).select(F.col("document_id").alias("id"), "number", "status"), "id")
    return catalog.post_filter(hits, "active", "src1").select("query_id", "id", F.col("rank").cast("int").alias("rank"), "number", "status")


@_query(
    f"""WITH h AS (SELECT item_id % 7 AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
n AS (SELECT query_id, count(*) AS total_found FROM h GROUP BY query_id), q AS (SELECT DISTINCT item_id % 7 AS query_id FROM benchmark)
SELECT query_id, coalesce(total_found, 0) AS total_found, CASE WHEN total_found IS NULL THEN '{fusion.NOTHING}' WHEN query_id % 2 = 0 THEN '{fusion.UNSURE}' END AS message
FROM q LEFT JOIN n USING (query_id)"""
)
def search_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of seven groups of passages by the documents that hold them."""
    quotes, contexts = _quotes(spark, sf_dir)
    hits = answers.grounded_pairs(quotes, contexts).where("exact").join(contexts, "context_id").join(quotes.withColumnRenamed("text", "quote"), "quote_id")
    hits = hits.where(F.contains("text", "quote")).select((F.col("quote_id") % 7).alias("query_id"))
    queries = quotes.select((F.col("quote_id") % 7).alias("query_id")).distinct()
    return fusion.messages(queries, hits, queries.withColumn("low_confidence", F.col("query_id") % 2 == 0))


# ---- listings and histories ------------------------------------------------


@_query(
    f"""WITH {LINES_SQL} SELECT id, document_id, page, CASE WHEN page % 3 = 1 THEN '5.' || page END AS paragraph FROM lines
ORDER BY page // 4, CASE WHEN page % 3 = 1 THEN '5.' || page END NULLS LAST, id OFFSET 50 LIMIT 100"""
)
def chunk_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("paragraph", F.when(F.col("page") % 3 == 1, F.concat(F.lit("5."), F.col("page").cast("string"))))
    rows = rows.select("id", "document_id", F.col("page").alias("line"), F.floor(F.col("page") / 4).alias("page"), "paragraph")
    return catalog.chunk_page(rows, 50, 100).select("id", "document_id", F.col("line").alias("page"), "paragraph")


@_query(
    f"""WITH {LINES_SQL} SELECT id, document_id, page, CASE WHEN page % 3 = 1 THEN '5.' || page END AS paragraph FROM lines
ORDER BY page // 4, CASE WHEN page % 3 = 1 THEN '5.' || page END NULLS LAST, id OFFSET 5000 LIMIT 5"""
)
def chunk_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 1,001 of five rows: one or two ranges of the listing are read for it."""
    rows = lines(spark, sf_dir).withColumn("paragraph", F.when(F.col("page") % 3 == 1, F.concat(F.lit("5."), F.col("page").cast("string"))))
    rows = rows.select("id", "document_id", F.col("page").alias("line"), F.floor(F.col("page") / 4).alias("page"), "paragraph")
    listing = Listing.write(rows, ["page", F.col("paragraph").asc_nulls_last(), "id"])
    return listing.page(5000, 5).select("id", "document_id", F.col("line").alias("page"), "paragraph")


@_query(
    f"""WITH {LINES_SQL}, k AS (SELECT CASE WHEN page % 10 = 7 THEN 'table' ELSE 'paragraph' END AS kind, page % 3 = 1 AS numbered, length(trim(text, ' ')) AS size FROM lines)
SELECT kind, numbered, count(*) AS n FROM k WHERE kind = 'table' OR size >= CASE WHEN numbered THEN 15 ELSE 25 END GROUP BY kind, numbered"""
)
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("kind", F.when(F.col("page") % 10 == 7, "table").otherwise("paragraph"))
    rows = rows.withColumn("paragraph", F.when(F.col("page") % 3 == 1, F.lit("5")))
    kept = rows.where(catalog.not_noise(F.col("text"), F.col("kind"), F.col("paragraph")))
    return kept.groupBy("kind", F.col("paragraph").isNotNull().alias("numbered")).agg(F.count("*").alias("n"))


@_query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.newest(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), "ts", "event_id").drop("ts")


@_query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY min(ts) DESC, user_id DESC LIMIT 20")
def newest_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("since"))
    return catalog.newest(users, "since", "user_id").drop("since")


@_query(
    f"""WITH {LOG_SQL}, c AS (SELECT lower(trim(text, ' ')) AS key, arg_min(text, ts) AS text, count(*) AS n, max(ts) AS last, min(ts) AS first FROM log WHERE trim(text, ' ') <> '' GROUP BY 1)
SELECT key, text, n, last FROM c ORDER BY n DESC, first, key LIMIT 20"""
)
def trending_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.trending(query_log(spark, sf_dir), 20)


@_query(
    f"""WITH {LOG_SQL}, r AS (SELECT user_id, text, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, text) AS place FROM log WHERE contains(lower(text), 'the'))
SELECT user_id, text, ts, CAST(place AS INT) AS place FROM r WHERE place <= 8"""
)
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.history_filter(query_log(spark, sf_dir), "The").withColumn("place", F.col("place").cast("int"))


@_query("SELECT CAST(count(*) AS BIGINT) AS total FROM labels JOIN documents USING (doc_id)")
def part_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("parts"))
    return catalog.part_total(table(spark, sf_dir, "documents").select("doc_id").join(counts, "doc_id", "left"))


@_query(
    """WITH u AS (SELECT 'collected' AS corpus, doc_id AS id, text, lang FROM documents UNION ALL SELECT 'demo', item_id, text, NULL FROM benchmark)
SELECT corpus, count(*) AS n, count(lang) AS with_lang, CAST(sum(length(text)) AS BIGINT) AS chars FROM u GROUP BY corpus"""
)
def corpora_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    demo = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    both = catalog.corpora(collected=table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), demo=demo)
    return both.groupBy("corpus").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.sum(F.length("text")).alias("chars"))


@_query(
    f"""WITH {DOCUMENTS_SQL}, r AS (SELECT document_id, number AS old, 'src' || (document_id % 50) AS by_number FROM docs WHERE status = 'replaced'),
n AS (SELECT number, min(document_id) AS successor_id, arg_min(status, document_id) AS successor_status FROM docs GROUP BY number)
SELECT r.document_id, old, by_number, coalesce(successor_id, -1) AS successor_id, successor_status FROM r LEFT JOIN n ON n.number = by_number"""
)
def successors_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    replaced = docs.where("status = 'replaced'").select("document_id", F.col("number").alias("old"), F.concat(F.lit("src"), (F.col("document_id") % 50).cast("string")).alias("by_number"))
    out = catalog.successors_by_number(docs, replaced)
    return out.select("document_id", "old", "by_number", F.coalesce("successor_id", F.lit(-1)).alias("successor_id"), "successor_status")


@_query(
    """WITH q AS (SELECT item_id AS query_id, unnest([item_id * 3 + 1, item_id * 3, 4000000000, item_id]) AS id, generate_subscripts([1, 2, 3, 4], 1) - 1 AS pos FROM benchmark)
SELECT query_id, CAST(pos AS INT) AS pos, id, lang FROM q JOIN documents ON doc_id = id WHERE pos < 3"""
)
def sources_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    ids = F.array(item * 3 + 1, item * 3, F.lit(4000000000).cast("long"), item)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return catalog.by_ids(docs, table(spark, sf_dir, "benchmark").select(item.alias("query_id"), ids.alias("ids")), 3).select("query_id", "pos", "id", "lang")


# ---- collected files and pages ---------------------------------------------


@_query(
    r"""WITH l AS (
  SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS title,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) - 1 AS pos FROM pages),
t AS (
  SELECT *, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^https?://[^/?#]+') || href ELSE regexp_extract(url, '^https?://[^/?#]+') || '/' || href END AS target
  FROM l WHERE contains(href, '/') AND length(trim(title, ' ')) >= 5 AND (contains(lower(title), 'th') OR contains(lower(title), 'en')))
SELECT url, CAST(pos AS INT) AS pos, href, trim(title, ' ') AS title, target, '' AS number, 'active' AS status FROM t QUALIFY row_number() OVER (PARTITION BY target ORDER BY url, pos) = 1"""
)
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected.listing(table(spark, sf_dir, "pages"), "/", ("th", "en"))


@_query(
    r"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
b AS (SELECT doc_id, CAST(pos // 12 AS INT) AS page, CAST(pos * 37 % 100 AS DOUBLE) AS x0, CAST(pos * 7 % 90 AS DOUBLE) AS y0, text FROM raw),
k AS (SELECT * FROM b WHERE trim(text, ' ') <> ''),
g AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY round_even(y0 / 20, 0), x0, y0, text) AS by_block, arg_min(x0, (round_even(y0 / 20, 0), x0, y0, text)) AS x0 FROM k GROUP BY doc_id, page),
p AS (SELECT doc_id, page, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN string_agg(text, ' ') || repeat('x', 500) ELSE 'short' END AS plain FROM b GROUP BY doc_id, page),
c AS (SELECT doc_id, page, x0, CASE WHEN length(trim(coalesce(by_block, ''), ' ')) > 0.9 * length(trim(plain, ' ')) OR trim(plain, ' ') = '' THEN coalesce(by_block, '') ELSE plain END AS text, doc_id % 3 = 1 AS long_ FROM p LEFT JOIN g USING (doc_id, page))
SELECT doc_id, page, CAST(length(text) AS INT) AS chars, CASE WHEN long_ THEN NULL ELSE md5(text) END AS hash, length(trim(text, ' ')) > 40 AS has_text, x0 FROM c"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks on pages, beside a plain text that is empty, longer or shorter."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    x0, y0 = (F.col("pos") * 37 % 100).cast("double"), (F.col("pos") * 7 % 90).cast("double")
    blocks = rows.select("doc_id", F.floor(F.col("pos") / 12).cast("int").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 10).alias("x1"), (y0 + 10).alias("y1"), "text")
    whole = F.concat(F.array_join(F.collect_list("text"), " "), F.lit("x" * 500))
    plain = blocks.groupBy("doc_id", "page").agg(whole.alias("whole"))
    plain = plain.select("doc_id", "page", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("whole")).otherwise("short").alias("text"))
    out = collected.page_texts(blocks, plain)
    return out.select("doc_id", "page", F.length("text").alias("chars"), F.when(F.col("doc_id") % 3 != 1, F.md5("text")).alias("hash"), "has_text", "x0")


@_query(
    """WITH s AS (SELECT 'doc' || (item_id * 5) AS stem, 'N' || item_id AS number, text AS title FROM benchmark)
SELECT 'doc' || doc_id AS stem, coalesce(s.number, source) AS number, coalesce(s.title, 'doc' || doc_id) AS title FROM documents LEFT JOIN s ON s.stem = 'doc' || doc_id"""
)
def sidecar_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("stem"), F.col("source").alias("number"), F.lit(None).cast("string").alias("title"))
    item = F.col("item_id")
    sidecar = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("doc"), (item * 5).cast("string")).alias("stem"), F.concat(F.lit("N"), item.cast("string")).alias("number"), F.col("text").alias("title"))
    return collected.with_metadata(docs, sidecar)


@_query(
    r"""WITH d AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'СНИП_' ELSE 'file_' END || doc_id AS stem,
         CASE doc_id % 5 WHEN 0 THEN 'см. Сн  рк 3.02-' || doc_id || ' и далее' WHEN 1 THEN 'СНиП 2.' || doc_id || '-85' WHEN 2 THEN 'СП РК - 1.0 12' ELSE lang END AS sample FROM documents),
m AS (SELECT *, regexp_extract(concat_ws(' ', sample, stem), '(?i)(СН\s*РК|СП\s*РК|СНиП|ГОСТ|СТ\s*РК)[\s\-]*([\d.\-]+\s*\d*)', ['k', 'n']) AS found FROM d),
n AS (SELECT *, CASE WHEN found.k <> '' THEN upper(found.k) || ' ' || trim(found.n, ' ') ELSE substr(stem, 1, 100) END AS number FROM m)
SELECT doc_id, number, replace(stem, '_', ' ') AS title,
       CASE WHEN contains(number, 'СН РК') THEN 'СН РК' WHEN contains(number, 'СП РК') THEN 'СП РК' WHEN contains(upper(number), 'СНИП') OR contains(upper(stem), 'СНИП') THEN 'СНиП' ELSE 'НТД' END AS kind FROM n"""
)
def document_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail, own = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    sample = F.when(tail == 0, F.concat(F.lit("см. Сн  рк 3.02-"), own, F.lit(" и далее"))).when(tail == 1, F.concat(F.lit("СНиП 2."), own, F.lit("-85")))
    sample = sample.when(tail == 2, "СП РК - 1.0 12").otherwise(F.col("lang"))
    docs = table(spark, sf_dir, "documents").select("doc_id", sample.alias("sample"), F.concat(F.when(tail == 4, "СНИП_").otherwise("file_"), own).alias("stem"))
    docs = docs.withColumn("number", tx.guessed_number(F.col("sample"), F.col("stem")))
    return docs.select("doc_id", "number", tx.guessed_title(F.lit(None).cast("string"), F.col("stem")).alias("title"), tx.guessed_type(F.col("number"), F.col("stem")).alias("kind"))


@_query(
    r"""WITH f AS (SELECT doc_id AS upload_id, source || ' / ' || lang || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.PDF' END AS name, n_chars AS size FROM documents),
k AS (SELECT *, regexp_replace(regexp_replace(name, '[^a-zA-Z0-9_.-]', '_', 'g'), '_+', '_', 'g') AS file FROM f WHERE size <= 2000 AND lower(name) LIKE '%.pdf'),
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY upload_id) - 1 AS nth FROM k)
SELECT upload_id, CASE WHEN nth = 0 THEN file ELSE replace(file, '.PDF', '') || '_' || nth || '.pdf' END AS file FROM n"""
)
def accepted_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit(" / "), "lang", F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".PDF"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("upload_id"), name.alias("name"), F.col("n_chars").alias("size"))
    return catalog.accepted_uploads(files, 2000).select("upload_id", "file")


@_query(
    """WITH w AS (SELECT doc_id, source || lang AS s, doc_id % 101 AS percent FROM documents),
h AS (
  SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s, ''), lambda c: unicode(c)::BIGINT)),
    lambda h, c: c + ((((h + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) * 32 + 2147483648) % 4294967296
      + CASE WHEN ((((h + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) * 32 + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END - 2147483648 - h) AS hash FROM w)
SELECT doc_id, CAST(abs(hash) % 360 AS INT) AS hue, CASE WHEN percent >= 90 THEN 'emerald' WHEN percent >= 75 THEN 'blue' WHEN percent >= 55 THEN 'amber' ELSE 'slate' END AS band FROM h"""
)
def badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.hue(F.concat("source", "lang")).alias("hue"), tx.relevance_band(F.col("doc_id") % 101).alias("band"))


# ---- answers ---------------------------------------------------------------


@_query(
    rf"""WITH t AS (SELECT item_id, list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-zß-ÿ0-9_\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS words FROM benchmark)
SELECT item_id, array_to_string(list_sort(list_filter(words, lambda w: length(w) >= 2)), ' ') AS tokens FROM t"""
)
def highlight_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_join(F.array_sort(tx.highlight_tokens(F.col("text"))), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", tokens.alias("tokens"))


@_query(
    rf"""WITH {_INDEX}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 5),
w AS (SELECT query_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\w\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: len(x) >= 2)) AS words FROM asked),
p AS (SELECT query_id, '(' || array_to_string(list_transform(list_sort(list_transform(words, lambda x: {{'l': -len(x), 'w': x}})), lambda x: x.w), '|') || ')' AS pattern FROM w)
SELECT query_id, CAST(rank AS INT) AS rank, id AS doc_id, md5(regexp_replace(text, '(?i)' || pattern, '<mark>\1</mark>', 'g')) AS marked,
       CAST(len(regexp_extract_all(text, '(?i)' || pattern)) AS BIGINT) AS marks
FROM r JOIN p USING (query_id) JOIN documents ON doc_id = id"""
)
def highlighted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each query with the words of their own query marked."""
    top = lexical.top_per_query(_bm25(spark, sf_dir), 5)
    tokens = _asked(spark).select("query_id", tx.highlight_tokens(F.col("text")).alias("tokens"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = docs.join(lexical.small(top.select("query_id", "id", "rank")), "id").join(lexical.small(tokens), "query_id")
    hits = hits.withColumn("marked", highlight_each(F.col("text"), F.col("tokens")))
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), F.md5("marked").alias("marked"), F.regexp_count("marked", F.lit("<mark>")).cast("long").alias("marks"))


@_query(
    rf"""WITH b AS (SELECT item_id, text, list_distinct(string_split({_SQUEEZE.format("text")}, ' ')) AS w FROM benchmark),
d AS (SELECT doc_id, text, list_distinct(string_split({_SQUEEZE.format("text")}, ' ')) AS c FROM documents),
n AS (SELECT item_id, doc_id, count(*) AS shared FROM (SELECT item_id, unnest(w) AS x FROM b) JOIN (SELECT doc_id, unnest(c) AS x FROM d) USING (x) GROUP BY item_id, doc_id),
r AS (
  SELECT item_id, doc_id, b.text AS quote, d.text AS text, row_number() OVER (PARTITION BY item_id ORDER BY round(shared / (len(w) + len(c) - shared), 9) DESC, doc_id) AS place
  FROM n JOIN b USING (item_id) JOIN d USING (doc_id))
SELECT item_id, doc_id, CASE WHEN item_id % 3 = 0 THEN item_id % 2 = 0
  ELSE contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' '), trim(regexp_replace(lower(quote), '\s+', ' ', 'g'), ' ')) END AS grounded FROM r WHERE place = 1"""
)
def strict_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage, or none, against the most similar document; without a quote the model's flag counts."""
    quotes, contexts = _quotes(spark, sf_dir)
    best = answers.most_similar(quotes, contexts).join(contexts, "context_id").join(quotes.withColumnRenamed("text", "quote"), "quote_id")
    said = F.col("quote_id") % 2 == 0
    grounded = answers.strict_grounded(F.when(F.col("quote_id") % 3 != 0, F.col("quote")), F.col("text"), said)
    return best.select(F.col("quote_id").alias("item_id"), F.col("context_id").alias("doc_id"), grounded.alias("grounded"))


@_query(
    rf"""WITH h AS (
  SELECT item_id AS query_id, r AS rank, 'p' || (doc_id % 5) AS paragraph, CAST(doc_id % 7 AS INT) AS page, d.text FROM benchmark, (SELECT unnest([1, 2]) AS r) JOIN documents d ON doc_id = item_id * 2 + r),
a AS (
  SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'Ответ НЕ НАЙДЕНО здесь' ELSE text END AS answer, 'p' || (item_id % 5) AS paragraph, CAST(CASE WHEN item_id % 2 = 0 THEN 9999 ELSE item_id + 1 END AS INT) AS page, text AS quote FROM benchmark),
w AS (SELECT h.query_id, rank, text, string_split({_SQUEEZE.format("quote")}, ' ') AS q, string_split({_SQUEEZE.format("text")}, ' ') AS c FROM h JOIN a USING (query_id)),
g AS (
  SELECT query_id, bool_or(contains(array_to_string(c, ' '), array_to_string(q, ' ')) OR (len(q) >= 5 AND
    coalesce(list_max(list_transform(range(1, greatest(len(c) - len(q) + 2, 1)), lambda i: len(list_filter(range(1, len(q) + 1), lambda j: q[j] = c[i + j - 1])) / len(q))), 0) >= 0.85)) AS was FROM w GROUP BY query_id),
j AS (SELECT *, len(list_intersect(list_distinct(q), list_distinct(c))) / (len(list_distinct(q)) + len(list_distinct(c)) - len(list_intersect(list_distinct(q), list_distinct(c)))) AS jac, substr(text, 1, 500) AS head FROM w),
s AS (SELECT *, length(head) - strpos(reverse(head), ' .') AS stop FROM j),
b AS (
  SELECT query_id, CASE WHEN arg_max(jac, (round(jac, 9), -rank)) > 0.15 THEN arg_max(trim(CASE WHEN strpos(reverse(head), ' .') > 0 AND stop - 1 > 200 THEN substr(head, 1, stop) ELSE head END, ' '), (round(jac, 9), -rank))
    ELSE trim(arg_min(head, rank), ' ') END AS better FROM s GROUP BY query_id)
SELECT query_id, coalesce(was, false) AS quote_was_grounded, NOT coalesce(was, false) AS quote_repaired, query_id % 3 = 0 AS not_found,
       CASE WHEN coalesce(list_contains((SELECT list(paragraph) FROM h WHERE h.query_id = a.query_id), paragraph), true) THEN paragraph ELSE (SELECT paragraph FROM h WHERE h.query_id = a.query_id AND rank = 1) END AS paragraph,
       CASE WHEN page BETWEEN 1 AND 5000 THEN page ELSE (SELECT page FROM h WHERE h.query_id = a.query_id AND rank = 1) END AS page,
       md5(CASE WHEN coalesce(was, false) THEN quote ELSE better END) AS quote, CASE WHEN query_id % 3 = 0 THEN '{answers.NOT_FOUND}' ELSE substr(answer, 1, 800) END AS answer
FROM a LEFT JOIN g USING (query_id) LEFT JOIN b USING (query_id)"""
)
def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of passages, held against two documents each."""
    items, item = table(spark, sf_dir, "benchmark"), F.col("item_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context"))
    ranked = items.select(item.alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).withColumn("doc_id", F.col("query_id") * 2 + F.col("rank"))
    hits = ranked.join(docs, "doc_id").select("query_id", "rank", F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string")).alias("paragraph"), (F.col("doc_id") % 7).cast("int").alias("page"), F.col("context").alias("text"))
    said = items.select(
        item.alias("query_id"), F.when(item % 3 == 0, "Ответ НЕ НАЙДЕНО здесь").otherwise(F.col("text")).alias("answer"), F.concat(F.lit("p"), (item % 5).cast("string")).alias("paragraph"),
        F.when(item % 2 == 0, 9999).otherwise(item + 1).cast("int").alias("page"), F.col("text").alias("quote"),
    )
    out = answers.checked_answers(said, hits)
    return out.select("query_id", "quote_was_grounded", "quote_repaired", "not_found", "paragraph", "page", F.md5("quote").alias("quote"), "answer")


# ---- the segmented store ---------------------------------------------------


@_query(
    f"""WITH {LINES_SQL},
old AS (SELECT id, document_id, text FROM lines),
again AS (SELECT doc_id * 4294967296 AS id, doc_id AS document_id, lower(text) AS text FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
alive AS (SELECT doc_id AS document_id, sha256(text) AS checksum FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
both_ AS (SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM again) UNION ALL SELECT * FROM again),
c AS (SELECT document_id, count(*) AS chunks, md5(string_agg(md5(text), '' ORDER BY id)) AS texts FROM both_ GROUP BY document_id),
p AS (SELECT document_id, CAST(sum(len({_tokens("text")})) AS BIGINT) AS tokens FROM both_ GROUP BY document_id)
SELECT document_id, checksum, coalesce(chunks, 0) AS chunks, texts, coalesce(tokens, 0) AS tokens FROM alive LEFT JOIN c USING (document_id) LEFT JOIN p USING (document_id)"""
)
def segmented_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are inserted, those of low quality indexed again, toxic ones deleted; then all tables are read back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("checksum"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality", "toxic")
    store = SegmentStore(spark, shared_path(spark, "segments"), LATIN, {"documents": "document_id long, checksum string", "chunks": "id long, document_id long, text string"})
    store.insert(docs.select("document_id", "checksum"), lines(spark, sf_dir).select("id", "document_id", "text"))
    poor = docs.join(labels.where("quality = 0"), "document_id", "left_semi")
    store.reindex(poor.select((F.col("document_id") * 4294967296).alias("id"), "document_id", F.lower("text").alias("text")))
    store.compact()
    store.delete(labels.where("toxic = 1"))
    chunks = store.table("chunks").groupBy("document_id").agg(F.count("*").alias("chunks"), F.sort_array(F.collect_list(F.struct("id", F.md5("text").alias("text")))).alias("parts"))
    tokens = store.table("postings").groupBy("document_id").agg(F.sum("tf").alias("tokens"))
    out = store.table("documents").join(chunks, "document_id", "left").join(tokens, "document_id", "left")
    none = F.lit(0).cast("long")
    return out.select("document_id", "checksum", F.coalesce("chunks", none).alias("chunks"), F.md5(F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("texts"), F.coalesce("tokens", none).alias("tokens"))
