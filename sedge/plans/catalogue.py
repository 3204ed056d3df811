"""The named queries over the driver's tables, each with its DuckDB SQL.

Query texts, filters and limits are the parameters of the queries; the tables
are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.profiles import LATIN
from ..operators import answers, blockmax, catalog, chunking, dense, expansion, fusion, grams, lexical, usage
from ..sources import artifacts, collected, vector_files
from ..sources.staging import shared_path, staged
from ..streaming import jobs
from .tables import DOCUMENTS_SQL, LINES_SQL, LOG_SQL, documents, lines, query_log, requests, table

QUERIES = ((1, "the ea tion of and inthe"), (2, "une eau que les ment"), (3, "Verkeit der UND zu, schst"))
TRIGRAM_QUERY = "therion onthe andthe"
SUGGESTION = "TH"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# ---- shared SQL ------------------------------------------------------------


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _tokens(text: str) -> str:
    keep = f"lambda w: len(w) >= 2 AND NOT list_contains({_quoted(LATIN.stopwords)}, w)"
    raw = f"list_filter(regexp_extract_all(replace(lower(coalesce({text}, '')), 'ё', 'е'), '{LATIN.token}'), {keep})"
    stem = rf"lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN w ELSE regexp_replace(w, '{LATIN.stem}', '\1') END"
    return f"list_filter(list_transform({raw}, {stem}), {keep})"


_QUERY_ROWS = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUERIES) + ") AS q(query_id, text))"
_INDEX = f"""{_QUERY_ROWS},
tok AS (SELECT doc_id AS id, {_tokens("text")} AS tokens FROM documents),
len_ AS (SELECT id, len(tokens) AS dl FROM tok),
stat AS (SELECT count(*) AS n, round(avg(dl), 2) AS avgdl FROM len_),
term AS (SELECT DISTINCT query_id, t AS term FROM asked, unnest({_tokens("text")}) AS x(t)),
post AS (SELECT t AS term, id, count(*) AS tf FROM tok, unnest(tokens) AS x(t) WHERE t IN (SELECT term FROM term) GROUP BY t, id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (
  SELECT query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (CASE WHEN dl = 0 THEN avgdl ELSE dl END) / avgdl)))), 6) AS score
  FROM term JOIN post USING (term) JOIN df USING (term) JOIN len_ USING (id), stat GROUP BY query_id, id)"""


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERIES), "query_id int, text string")


def _counted(spark: SparkSession, sf_dir: str, terms: DataFrame | None = None) -> DataFrame:
    return lexical.counted(lexical.occurrences(table(spark, sf_dir, "documents"), LATIN, "doc_id"), terms)


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id, score) of the queries over whole documents."""
    terms = lexical.query_terms(_asked(spark), LATIN)
    counted = _counted(spark, sf_dir, terms)
    sizes = lexical.lengths(counted)
    out = lexical.bm25(terms, lexical.postings(counted), sizes, lexical.statistics(sizes))
    return out.withColumn("score", F.round("score", 6))


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _probes(vectors: DataFrame, which: str = "id % 100 = 0") -> DataFrame:
    """Vectors as queries: every hundredth."""
    return vectors.where(which).select(F.col("id").cast("int").alias("query_id"), F.col("v").alias("qv"))


def _dense(which: str) -> str:
    return f"""near AS (
  SELECT CAST(q.vec_id AS INT) AS query_id, v.vec_id AS id,
         round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings v JOIN embeddings q ON {which} WHERE v.embedding IS NOT NULL)"""


#: The fusions have three text queries; vectors 1 to 3 are their embeddings.
_DENSE = _dense("q.vec_id IN (1, 2, 3)")


def _near(spark: SparkSession, sf_dir: str, which: str = "id IN (1, 2, 3)") -> DataFrame:
    v = _unit(spark, sf_dir)
    return dense.cosine_scores(_probes(v, which), v).withColumn("score", F.round("score", 6))


# ---- lexical index and search ----------------------------------------------


@_query(
    f"""WITH {_INDEX}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)
SELECT query_id, CAST(rank AS INT) AS rank, id AS doc_id, score, source FROM r LEFT JOIN documents ON doc_id = id WHERE rank <= 10"""
)
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = lexical.query_terms(_asked(spark), LATIN)
    counted = staged(_counted(spark, sf_dir, terms), "counted")
    sizes = lexical.lengths(counted)
    top = blockmax.top(terms, *blockmax.shard_lists(lexical.postings(counted), sizes, lexical.statistics(sizes)), 10)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return top.join(docs, "id", "left").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score", "source")


@_query(f"""SELECT doc_id, CAST(len({_tokens("text")}) AS BIGINT) AS dl, CAST(len(regexp_extract_all(text, '[^\\s]+')) AS INT) AS words FROM documents""")
def tokenize_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokenize(F.col("text"), LATIN)).cast("bigint").alias("dl"), tx.token_count(F.col("text")).alias("words"))


@_query(
    f"""WITH tok AS (SELECT doc_id AS id, {_tokens("text")} AS tokens FROM documents),
post AS (SELECT t AS term, id, count(*) AS tf FROM tok, unnest(tokens) AS x(t) GROUP BY t, id)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, min(id) AS first_id, max(id) AS last_id, max(tf) AS max_tf FROM post GROUP BY term"""
)
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = lexical.postings(_counted(spark, sf_dir))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("tf").alias("max_tf"))


@_query(
    f"""WITH tok AS (SELECT doc_id AS id, {_tokens("text")} AS tokens FROM documents),
post AS (SELECT t AS term, id, count(*) AS tf FROM tok, unnest(tokens) AS x(t) GROUP BY t, id),
placed AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY id) - 1) // 256 AS segment FROM post)
SELECT term, segment, count(*) AS n, string_agg(id || ':' || tf, ' ' ORDER BY id) AS list FROM placed GROUP BY term, segment"""
)
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = lexical.posting_segments(lexical.posting_rows(table(spark, sf_dir, "documents"), LATIN, "doc_id"), 256)
    entry = F.transform("list", lambda x: F.concat_ws(":", x["id"].cast("string"), x["tf"].cast("string")))
    return segments.select("term", "segment", "n", F.array_join(entry, " ").alias("list"))


@_query(f"""WITH len_ AS (SELECT len({_tokens("text")}) AS dl FROM documents) SELECT count(*) AS n, round(avg(dl), 2) AS avgdl FROM len_""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.statistics(lexical.lengths(_counted(spark, sf_dir, spark.createDataFrame([], "term string"))))


_NORMAL = r"trim(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), '[^\p{L}\p{M}\p{N}_\s\-]', ' ', 'g'), '\s+', ' ', 'g'))"


@_query(
    rf"""SELECT doc_id, md5({_NORMAL}) AS server, md5(trim(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), '[^a-zа-я0-9_\s-]', ' ', 'g'), '\s+', ' ', 'g'))) AS client
FROM documents"""
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize_query(F.col("text"))).alias("server"), F.md5(tx.normalize_query_client(F.col("text"))).alias("client"))


@_query(
    f"""WITH {_INDEX}, want AS (SELECT query_id, count(*) AS n FROM term GROUP BY query_id),
got AS (SELECT query_id, id, count(*) AS n FROM term JOIN post USING (term) GROUP BY query_id, id)
SELECT query_id, id FROM got JOIN want USING (query_id, n)"""
)
def fts_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = lexical.query_terms(_asked(spark), LATIN)
    return lexical.match_all(terms, lexical.postings(_counted(spark, sf_dir, terms)))


@_query(
    """SELECT doc_id, 0.5::DOUBLE AS score FROM documents
WHERE contains(lower(text), 'eauau') OR contains(lower(text), 'schst') OR contains(lower(text), 'therion') ORDER BY doc_id LIMIT 50"""
)
def ilike_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "eauau schst of therion")], "query_id int, text string").withColumn("words", grams.fallback_words(F.col("text")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hit = grams.contains_search(rows, asked)
    return hit.select(F.col("id").alias("doc_id"), F.lit(0.5).alias("score")).orderBy("doc_id").limit(50)


def _sql_grams(text: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@_query(
    f"""WITH g AS (SELECT item_id, {_sql_grams("text")} AS a, {_sql_grams(f"'{TRIGRAM_QUERY}'")} AS b FROM benchmark),
s AS (SELECT item_id, len(list_intersect(a, b)) AS i, len(a) + len(b) AS t FROM g)
SELECT item_id, round(i / (t - i), 6) AS sim FROM s WHERE i / (t - i) > 0.05 ORDER BY sim DESC, item_id LIMIT 20"""
)
def trigram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id")
    asked = spark.createDataFrame([(1, TRIGRAM_QUERY)], "query_id int, text string")
    found = grams.trigram_search(rows, asked, least=0.05).withColumn("sim", F.round("sim", 6))
    return found.select(F.col("id").alias("item_id"), "sim").orderBy(F.desc("sim"), "item_id").limit(20)


_COVER = ("ea", "or", "on")


@_query(
    f"""WITH tok AS (SELECT doc_id AS id, {_tokens("text")} AS tokens FROM documents),
w AS (SELECT id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM tok),
o AS (SELECT id, t, i, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM w WHERE t IN {_COVER}),
p AS (SELECT id, i, n, {", ".join(f"max(CASE WHEN t = '{t}' THEN i END) OVER u AS p{k}, max(CASE WHEN t = '{t}' THEN n END) OVER u AS n{k}" for k, t in enumerate(_COVER))}
  FROM o WINDOW u AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT id, i, n, least(p0, p1, p2) AS low, least(n0, n1, n2) AS first_ FROM p WHERE p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL),
f AS (SELECT *, lag(low) OVER (PARTITION BY id ORDER BY i) AS before FROM l)
SELECT id, round(sum(0.1 / (1 + (i - low) - (n - first_))), 6) AS score FROM f WHERE before IS NULL OR low > before GROUP BY id ORDER BY score DESC, id LIMIT 50"""
)
def cover_density_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lexical.tokenized(table(spark, sf_dir, "documents"), LATIN, "doc_id")
    found = lexical.cover_density(tokens, list(_COVER)).withColumn("score", F.round("score", 6))
    return found.orderBy(F.desc("score"), "id").limit(50)


# ---- vectors ---------------------------------------------------------------


@_query(
    f"""WITH {_dense("q.vec_id % 100 = 0")}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""
)
def knn_cosine_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _unit(spark, sf_dir)
    return dense.cosine_top(_probes(v), v, 10).withColumn("rank", F.col("rank").cast("int"))


_INT8 = """sc AS (
  SELECT vec_id, embedding, CASE WHEN m = 0 THEN 1.0 ELSE m / 127 END AS scale FROM (
    SELECT vec_id, embedding, CAST(greatest(list_max(embedding), -list_min(embedding)) AS DOUBLE) AS m FROM embeddings WHERE embedding IS NOT NULL)),
qz AS (SELECT vec_id, embedding, scale, list_transform(embedding, lambda x: greatest(least(round_even(CAST(x AS DOUBLE) / scale, 0), 127), -128)) AS q FROM sc)"""


@_query(
    f"""WITH {_INT8}, s AS (
  SELECT CAST(p.vec_id AS INT) AS query_id, z.vec_id AS id, round(z.scale * list_dot_product(CAST(z.q AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
  FROM qz z JOIN embeddings p ON p.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""
)
def knn_int8_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _unit(spark, sf_dir)
    return dense.int8_top(_probes(v), vx.quantize(v.where("v is not null"), "v"), 10).withColumn("rank", F.col("rank").cast("int"))


@_query(
    f"""WITH {_INT8}, e AS (
  SELECT vec_id AS id, round(list_max(list_transform(list_zip(embedding, q), lambda p: abs(CAST(p[1] AS DOUBLE) - scale * p[2]))), 6) AS error,
         round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM qz)
SELECT * FROM e"""
)
def int8_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = vx.quantize(_unit(spark, sf_dir).where("v is not null"), "v")
    error = F.array_max(F.zip_with("v", "q", lambda x, c: F.abs(x.cast("double") - F.col("scale") * c)))
    return z.select("id", F.round(error, 6).alias("error"), F.round(vx.norm(F.col("v")), 6).alias("norm"))


@_query(
    """WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY label, pos),
n AS (SELECT label, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM m GROUP BY label)
SELECT label, CAST(pos - 1 AS INT) AS pos, round(x / n, 6) AS x FROM m JOIN n USING (label)"""
)
def centroid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = vx.centroid(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return mean.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


# ---- expansion, fusion, guards ---------------------------------------------


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.squeeze(F.col("text")).alias("text"))


def _sql_variants(first_only: bool) -> str:
    tried = ["text"]
    for key, alternatives in LATIN.synonyms.items():
        for s in alternatives[:2]:
            swap = f"substr(text, 1, strpos(text, '{key}') - 1) || '{s}' || substr(text, strpos(text, '{key}') + {len(key)})" if first_only else f"replace(text, '{key}', '{s}')"
            tried.append(f"CASE WHEN contains(text, '{key}') THEN {swap} END")
    return "[" + ", ".join(tried) + "]"


def _sql_expand(first_only: bool, name: str) -> str:
    return f"""SELECT query_id, '{name}' AS kind, variant, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS INT) AS pos FROM (
    SELECT query_id, variant, min(p) AS p FROM (SELECT query_id, unnest({_sql_variants(first_only)}) AS variant, generate_subscripts({_sql_variants(first_only)}, 1) AS p FROM b)
    WHERE variant IS NOT NULL GROUP BY query_id, variant) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p) <= 3"""


@_query(
    rf"""WITH b AS (SELECT item_id AS query_id, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '\s+', ' ', 'g')) AS text FROM benchmark)
{_sql_expand(False, "server")} UNION ALL {_sql_expand(True, "client")}"""
)
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _passages(spark, sf_dir)
    server = expansion.expand(asked, LATIN.synonyms).withColumn("kind", F.lit("server"))
    return server.unionByName(expansion.expand(asked, LATIN.synonyms, first_only=True).withColumn("kind", F.lit("client")))


_SERVER = f"""{_INDEX}, {_DENSE},
a AS (SELECT query_id, id, score AS bm, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS br FROM bm QUALIFY br <= 50),
v AS (SELECT query_id, id, score AS vec, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS vr FROM near QUALIFY vr <= 50),
f AS (
  SELECT *, coalesce(nullif(max(coalesce(bm, 0)) OVER (PARTITION BY query_id), 0), 1) AS mb, coalesce(nullif(max(coalesce(vec, 0)) OVER (PARTITION BY query_id), 0), 1) AS mv
  FROM a FULL JOIN v USING (query_id, id)),
g AS (
  SELECT *, round((CASE WHEN br IS NOT NULL THEN 1 / (60 + br) + 0.15 * bm / mb ELSE 0 END) + (CASE WHEN vr IS NOT NULL THEN 1 / (60 + vr) + 0.20 * vec / mv ELSE 0 END), 9) AS rrf FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS place FROM g QUALIFY place <= 30),
i AS (SELECT *, rrf / coalesce(nullif(max(rrf) OVER (PARTITION BY query_id), 0), 1) AS share FROM h),
j AS (
  SELECT *, round(greatest(0, least(1, CASE WHEN coalesce(vec, 0) <> 0 THEN 0.55 * share + 0.45 * vec / mv ELSE share END)), 9) AS fusion FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, id) AS rank FROM j QUALIFY rank <= 10),
fused AS (SELECT *, CAST(greatest(10, least(98, floor(round(fusion * 100, 6)))) AS INT) AS percent FROM k)"""


def _sql_label(*least: int) -> str:
    return "CASE " + " ".join(f"WHEN percent >= {n} THEN '{x}'" for x, n in zip(fusion.LABELS, least)) + f" ELSE '{fusion.LABELS[-1]}' END"


def _server(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda df: lexical.top_per_query(df, 50).drop("rank")
    return fusion.server_fusion(cut(_bm25(spark, sf_dir)), cut(_near(spark, sf_dir)))


@_query(f"""WITH {_SERVER} SELECT query_id, id, bm, vec, round(rrf, 6) AS rrf, round(fusion, 6) AS fusion, percent, {_sql_label(90, 75, 55)} AS label, CAST(rank AS INT) AS rank FROM fused""")
def rrf_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _server(spark, sf_dir)
    return out.withColumns({"rrf": F.round("rrf", 6), "fusion": F.round("fusion", 6), "rank": F.col("rank").cast("int")})


@_query(
    f"""WITH {_INDEX}, {_DENSE},
l AS (
  SELECT query_id, id, score AS bm, NULL::DOUBLE AS vec, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm
  UNION ALL SELECT query_id, id, NULL, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM near),
u AS (SELECT query_id, id, max(bm) AS bm, max(vec) AS vec, round(sum(1 / (60 + r)), 9) AS rrf FROM l GROUP BY query_id, id),
t AS (SELECT *, max(rrf) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM u QUALIFY rank <= 10),
p AS (SELECT *, CAST(greatest(10, least(98, floor(round(10 + 88 * (0.6 * rrf / best + 0.4 * coalesce(vec, 0)), 6) + 0.5))) AS INT) AS percent FROM t)
SELECT query_id, id, bm, vec, round(rrf, 6) AS rrf, percent, {_sql_label(85, 70, 55)} AS label, CAST(rank AS INT) AS rank FROM p"""
)
def rrf_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.client_fusion(_bm25(spark, sf_dir).withColumn("variant", F.lit(0)), _near(spark, sf_dir))
    return out.withColumns({"rrf": F.round("rrf", 6), "rank": F.col("rank").cast("int")})


@_query(
    f"""WITH {_SERVER}, s AS (
  SELECT query_id, coalesce(arg_min(coalesce(bm, 0), rank), 0) AS bm, coalesce(arg_min(coalesce(vec, 0), rank), 0) AS vec, arg_min(fusion, rank) AS fusion,
         coalesce(max(bm), 0) AS mb, coalesce(max(vec), 0) AS mv, max(fusion) AS mf, bool_or(vec IS NOT NULL) AS has_vec FROM fused GROUP BY query_id)
SELECT query_id, CASE WHEN n < 2000
  THEN CASE WHEN has_vec THEN mf < 0.35 AND ((vec < 0.25 AND bm < 0.005) OR (mv < 0.25 AND mb < 0.005)) ELSE mb < 0.005 AND mf < 0.35 END
  ELSE CASE WHEN has_vec THEN (vec < 0.32 AND bm < 0.01) OR (vec < 0.33 AND mb < 0.005 AND mv < 0.33) ELSE bm < 0.01 AND fusion < 0.35 END END AS low_confidence,
  greatest(mv, 0) < (CASE WHEN n < 2000 THEN 0.25 ELSE 0.32 END) AND mb < 0.005 AS weak FROM s, stat"""
)
def confidence_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    hits = _server(spark, sf_dir)
    return fusion.server_guard(hits, size).join(fusion.client_guard(_asked(spark), hits, size), "query_id")


_CASCADE = ((1, "the ea tion of and inthe"), (2, "zzqx the"), (3, "zzzz qqqq"), (4, "therion onthe andthe zz"))


@_query(
    f"""WITH asked AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in _CASCADE)}) AS q(query_id, text)),
term AS (SELECT DISTINCT query_id, t AS term FROM asked, unnest({_tokens("text")}) AS x(t)),
tok AS (SELECT doc_id AS id, text, {_tokens("text")} AS tokens FROM documents),
post AS (SELECT DISTINCT t AS term, id FROM tok, unnest(tokens) AS x(t)),
want AS (SELECT query_id, count(*) AS n FROM term GROUP BY query_id),
fts AS (SELECT query_id, id FROM (SELECT query_id, id, count(*) AS n FROM term JOIN post USING (term) GROUP BY query_id, id) JOIN want USING (query_id, n)),
word AS (SELECT * FROM (VALUES (1, 'the'), (1, 'tion'), (1, 'and'), (1, 'inthe'), (2, 'zzqx'), (2, 'the'), (3, 'zzzz'), (3, 'qqqq'), (4, 'therion'), (4, 'onthe'), (4, 'andthe')) AS w(query_id, word)),
like_ AS (SELECT DISTINCT query_id, id FROM tok JOIN word ON contains(lower(text), word) WHERE query_id NOT IN (SELECT query_id FROM fts)),
rest AS (SELECT * FROM asked WHERE query_id NOT IN (SELECT query_id FROM fts) AND query_id NOT IN (SELECT query_id FROM like_)),
gram AS (SELECT id, {_sql_grams("text")} AS a FROM tok),
tri AS (
  SELECT query_id, id, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS sim FROM gram, (SELECT query_id, {_sql_grams("text")} AS b FROM rest))
SELECT query_id, id, 1.0::DOUBLE AS score, 'fts' AS source FROM fts
UNION ALL SELECT query_id, id, 0.5::DOUBLE, 'ilike' FROM like_
UNION ALL SELECT query_id, id, round(sim * 0.8, 6), 'trigram' FROM tri WHERE sim > 0.002"""
)
def fallback_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(list(_CASCADE), "query_id int, text string").withColumn("words", grams.fallback_words(F.col("text")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    terms = lexical.query_terms(asked, LATIN)
    fts = lexical.match_all(terms, lexical.postings(_counted(spark, sf_dir, terms))).withColumn("score", F.lit(1.0))
    return grams.cascade(fts, rows, asked, least=0.002).withColumn("score", F.round("score", 6))


# ---- filters, catalogue ----------------------------------------------------


@_query(
    f"""WITH {_INDEX}, {DOCUMENTS_SQL},
pre AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm JOIN docs ON document_id = id WHERE status = 'active' AND (owner_id = 'owner3' OR owner_id IS NULL) QUALIFY r <= 10),
post_ AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 10) JOIN docs ON document_id = id WHERE status = 'active' AND (owner_id = 'owner3' OR owner_id IS NULL))
SELECT query_id, id, 'pre' AS kind FROM pre UNION ALL SELECT query_id, id, 'post' FROM post_"""
)
def filters_pre_vs_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = documents(spark, sf_dir).where(catalog.visible({"owner_id": "owner3"})).select(F.col("document_id").alias("id"))
    scores = _bm25(spark, sf_dir)
    pre = lexical.top_per_query(scores.join(seen, "id", "left_semi"), 10).select("query_id", "id", F.lit("pre").alias("kind"))
    post = lexical.top_per_query(scores, 10).join(seen, "id", "left_semi").select("query_id", "id", F.lit("post").alias("kind"))
    return pre.unionByName(post)


@_query(
    f"""WITH {DOCUMENTS_SQL}, cases AS (
  SELECT 'absent' AS kind, * FROM docs WHERE status = 'active'
  UNION ALL SELECT 'null', * FROM docs WHERE status = 'active' AND owner_id IS NULL
  UNION ALL SELECT 'expired', * FROM docs WHERE status = 'expired' AND language = 'en'
  UNION ALL SELECT 'all', * FROM docs WHERE type = 'type-fr')
SELECT kind, count(*) AS n, CAST(sum(document_id) AS BIGINT) AS ids FROM cases GROUP BY kind"""
)
def tenancy_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    cases = {"absent": {}, "null": {"owner_id": None}, "expired": {"status": "expired", "language": "en"}, "all": {"include_expired": True, "type": "type-fr"}}
    out = None
    for kind, filters in cases.items():
        part = docs.where(catalog.visible(filters)).select(F.lit(kind).alias("kind"), "document_id")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("document_id").alias("ids"))


@_query(
    f"""WITH {DOCUMENTS_SQL}, c AS (SELECT doc_id AS document_id, count(*) AS parts FROM labels GROUP BY doc_id)
SELECT document_id, number, status, coalesce(parts, 0) AS parts FROM docs LEFT JOIN c USING (document_id) ORDER BY updated DESC, document_id OFFSET 20 LIMIT 50"""
)
def doc_catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "document_id")
    page = catalog.catalog_page(documents(spark, sf_dir).select("document_id", "number", "status", "updated_at"), parts, 20, 50, (F.desc("updated_at"), "document_id"))
    return page.drop("updated_at")


@_query(
    f"""WITH {DOCUMENTS_SQL}, {LINES_SQL}
SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs WHERE status = 'active') AS active, (SELECT count(*) FROM lines) AS chunks,
       (SELECT document_id FROM docs ORDER BY updated DESC, document_id DESC LIMIT 1) AS newest"""
)
def corpus_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dashboard(documents(spark, sf_dir), lines(spark, sf_dir))


@_query(
    f"""WITH {LINES_SQL}, {DOCUMENTS_SQL}
SELECT id, document_id, page, number AS document_number, substr(lines.text, 1, 600) AS quote FROM lines JOIN docs USING (document_id)
WHERE status = 'active' AND length(lines.text) >= 25 ORDER BY page, id OFFSET 10 LIMIT 100"""
)
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.with_documents(lines(spark, sf_dir), documents(spark, sf_dir).drop("text", "checksum"))
    rows = catalog.search_projection(rows.where(catalog.visible({}) & (F.length("text") >= chunking.NOISE)))
    return rows.select("id", "document_id", "page", "document_number", "quote").orderBy("page", "id").offset(10).limit(100)


@_query(
    f"""WITH {DOCUMENTS_SQL}, p AS (SELECT user_id, event_id AS document_id, min(ts) AS created_at FROM events WHERE event_type = 'click' GROUP BY 1, 2),
r AS (SELECT user_id, document_id, number, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, document_id DESC) AS place FROM p JOIN docs USING (document_id))
SELECT user_id, document_id, number, CAST(place AS INT) AS place FROM r WHERE place <= 50"""
)
def pins_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'")
    pinned = clicks.select("user_id", F.col("event_id").alias("document_id"), F.col("ts").alias("created_at"))
    out = catalog.pins(pinned, documents(spark, sf_dir).select("document_id", "number"))
    return out.select("user_id", "document_id", "number", F.col("place").cast("int").alias("place"))


@_query("""SELECT sha256(text) AS checksum, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1""")
def dedup_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("checksum").agg(F.min("document_id").alias("first_id"), F.count("*").alias("copies"))


@_query(
    f"""WITH {DOCUMENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY owner_id, number ORDER BY document_id) AS nth FROM docs)
SELECT document_id, owner_id, CASE WHEN nth > 1 THEN number || ' (' || substr(checksum, 1, 6) || ')' ELSE number END AS unique_number FROM r"""
)
def number_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("document_id", "owner_id", "number", "checksum")
    return catalog.unique_numbers(rows).select("document_id", "owner_id", "unique_number")


@_query(
    f"""WITH {DOCUMENTS_SQL} SELECT d.document_id, d.number, n.number AS successor, n.status AS successor_status
FROM docs d LEFT JOIN docs n ON d.replaced_by_id = n.document_id WHERE d.status = 'replaced'"""
)
def superseded_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.successors(documents(spark, sf_dir)).where("status = 'replaced'").select("document_id", "number", "successor", "successor_status")


@_query(
    f"""WITH {DOCUMENTS_SQL} SELECT document_id, number, title FROM docs WHERE contains(lower(number), '{SUGGESTION.lower()}') OR contains(lower(title), '{SUGGESTION.lower()}')
ORDER BY document_id LIMIT 5"""
)
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.suggestions(documents(spark, sf_dir).select("document_id", "number", "title"), SUGGESTION)


@_query(
    f"""WITH {DOCUMENTS_SQL} SELECT count(*) AS n, CAST(sum(document_id) AS BIGINT) AS ids FROM docs
WHERE document_id NOT IN (SELECT document_id FROM docs WHERE status = 'expired' AND owner_id IS NULL)"""
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    left = catalog.delete_documents(docs, docs.where("status = 'expired'").select("document_id"), F.col("owner_id").isNull())
    return left.agg(F.count("*").alias("n"), F.sum("document_id").alias("ids"))


# ---- collected pages -------------------------------------------------------


@_query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS target FROM pages)
SELECT min(page_id) AS page_id, target FROM p WHERE target NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 4 = 0) GROUP BY target"""
)
def new_remote_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("target"))
    fresh = catalog.new_rows(remote, remote.where("page_id % 4 = 0"), ["target"])
    return fresh.groupBy("target").agg(F.min("page_id").alias("page_id"))


# The SQL has a narrower pattern of its own: links of the given pages have an href alone.
_LINK = '<a href="([^"]*)">([^<]*)</a>'


@_query(
    rf"""WITH l AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS title,
         generate_subscripts(regexp_extract_all(html, '{_LINK}', 1), 1) - 1 AS pos FROM pages)
SELECT url, CAST(pos AS INT) AS pos, href, trim(regexp_replace(title, '<[^>]*>', '', 'g'), ' ') AS title,
       CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
            ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || href END AS target FROM l"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected.links(table(spark, sf_dir, "pages"))


# ---- chunks ----------------------------------------------------------------


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of numbered clauses: every third line starts one, every tenth a chapter."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    line = F.when(F.col("i") % 10 == 0, F.concat(F.lit("Глава "), (F.col("i") / 10 + 1).cast("int").cast("string")))
    line = line.when(F.col("i") % 10 == 7, F.concat(F.lit("Таблица "), F.col("i").cast("string"), F.lit(" "), "t"))
    line = line.when(F.col("i") % 3 == 1, F.concat(F.lit("5."), F.col("i").cast("string"), F.lit(" "), "t")).otherwise(F.col("t"))
    parts = rows.select("doc_id", (F.col("i") / 20).cast("int").alias("page"), F.struct("i", line.alias("t")).alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n")
    return parts.groupBy("doc_id", "page").agg(joined.alias("text"))


# White space that a line loses at its ends (Unicode's), and the ASCII one of the patterns of lines.
_EDGE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_GAP = r"[\t-\r ]"


@_query(
    rf"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
named AS (
  SELECT doc_id, i, i // 20 AS page, CASE WHEN i % 10 = 0 THEN 'Глава ' || (i // 10 + 1) WHEN i % 10 = 7 THEN 'Таблица ' || i || ' ' || t WHEN i % 3 = 1 THEN '5.' || i || ' ' || t ELSE t END AS line FROM raw),
l AS (SELECT doc_id, i, page, regexp_replace(line, '^{_EDGE}|{_EDGE}$', '', 'g') AS line FROM named),
k AS (
  SELECT *, CASE WHEN regexp_matches(line, '(?i)^Таблица{_GAP}+[0-9]+') THEN 'table' WHEN regexp_matches(line, '(?i)^(Глава|Раздел|Приложение){_GAP}+([0-9]+|[А-ЯA-Z])') THEN 'chapter'
    WHEN regexp_matches(line, '^[0-9]+(\.[0-9]+){{1,4}}[.)]?{_GAP}+') THEN 'paragraph' ELSE 'text' END AS kind FROM l WHERE line <> ''),
s AS (
  SELECT *, kind IN ('paragraph', 'table') OR (kind = 'text' AND coalesce(lag(kind) OVER (PARTITION BY doc_id, page ORDER BY i), 'none') IN ('none', 'table', 'chapter')) AS starts,
         last_value(CASE WHEN kind = 'chapter' THEN substr(line, 1, 250) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM k),
g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM s WHERE true)
SELECT doc_id, CAST(page AS INT) AS page, CAST(seg AS BIGINT) AS segment, arg_min(chapter, i) AS chapter,
       CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS chars FROM g WHERE kind <> 'chapter' GROUP BY doc_id, page, seg"""
)
def paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.segments(_numbered(spark, sf_dir))
    return rows.select("doc_id", "page", F.col("segment").cast("bigint").alias("segment"), "chapter", F.length("text").cast("bigint").alias("chars"))


@_query(
    r"""WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
line AS (
  SELECT doc_id, i, i // 20 AS page, trim(CASE WHEN i % 10 = 0 THEN 'Глава ' || (i // 10 + 1) WHEN i % 10 = 7 THEN 'Таблица ' || i || ' ' || t WHEN i % 3 = 1 THEN '5.' || i || ' ' || t ELSE t END, ' ' || chr(9) || chr(13)) AS text FROM raw),
k AS (
  SELECT *, CASE WHEN regexp_matches(text, '(?i)^Таблица\s+\d+') THEN 'table' WHEN regexp_matches(text, '(?i)^(Глава|Раздел|Приложение)\s+(\d+|[А-ЯA-Z])') THEN 'chapter'
    WHEN regexp_matches(text, '^\d+(\.\d+){1,4}[.)]?\s+') THEN 'paragraph' ELSE 'text' END AS kind FROM line WHERE text <> ''),
n AS (
  SELECT *, CASE WHEN kind = 'paragraph' THEN regexp_extract(text, '^(\d+(?:\.\d+){1,4})', 1) ELSE nullif(regexp_extract(text, '^.*?(\d+\.\d+(?:\.\d+)*)\s+[А-ЯA-Z]', 1), '') END AS number,
    kind IN ('paragraph', 'table') OR (kind = 'text' AND coalesce(lag(kind) OVER (PARTITION BY doc_id, page ORDER BY i), 'none') IN ('none', 'table', 'chapter')) AS starts FROM k),
p AS (
  SELECT *, sum(starts::INT) OVER so_far AS segment, last_value(CASE WHEN kind = 'chapter' THEN substr(text, 1, 250) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter,
    CASE WHEN kind = 'table' THEN coalesce((last_value(CASE WHEN starts AND kind <> 'table' THEN {'p': number} END IGNORE NULLS) OVER so_far).p, 'Таблица ' || regexp_extract(text, '(?i)^Таблица\s+(\d+)', 1)) ELSE number END AS paragraph
  FROM n WINDOW so_far AS (PARTITION BY doc_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
seg AS (
  SELECT doc_id, page, segment, first(chapter ORDER BY i) AS chapter, first(paragraph ORDER BY i) AS paragraph, CASE WHEN first(kind ORDER BY i) = 'table' THEN 'table' ELSE 'paragraph' END AS type, string_agg(text, ' ' ORDER BY i) AS text
  FROM p WHERE kind <> 'chapter' GROUP BY doc_id, page, segment),
win AS (
  SELECT doc_id, page, segment, text, 0 AS part, 0 AS b, substr(text, 1, 2800) AS w FROM seg WHERE length(text) > 2800 AND type <> 'table'
  UNION ALL
  SELECT doc_id, page, segment, text, part + 1, e - 600, substr(text, e - 600 + 1, 2800) FROM (
    SELECT *, b + CASE WHEN stop > 1540 THEN stop + 1 WHEN strpos(reverse(w), ' ') > 0 AND 2800 - strpos(reverse(w), ' ') > 2240 THEN 2800 - strpos(reverse(w), ' ') ELSE 2800 END AS e FROM (
      SELECT *, list_max(list_transform(['.', '!', '?', ';'], lambda m: CASE WHEN contains(w, m || ' ') THEN 2799 - strpos(reverse(w), ' ' || m) ELSE -1 END)) AS stop FROM win WHERE b + 2800 < length(text)))),
cut AS (SELECT *, coalesce(lead(b) OVER (PARTITION BY doc_id, page, segment ORDER BY part) + 600, length(text)) AS e FROM win),
part AS (
  SELECT doc_id, page, segment, 0 AS part, chapter, paragraph, type, text FROM seg WHERE length(text) <= 2800 OR type = 'table'
  UNION ALL SELECT doc_id, page, segment, part, chapter, paragraph, type, trim(substr(cut.text, b + 1, e - b), ' ') FROM cut JOIN seg USING (doc_id, page, segment)),
lasting AS (SELECT *, type = 'table' OR length(trim(text, ' ')) >= CASE WHEN paragraph IS NOT NULL THEN 15 ELSE 25 END AS lasts FROM part),
met AS (SELECT *, last_value(CASE WHEN lasts THEN {'p': paragraph, 't': type} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, segment, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM lasting),
joined AS (SELECT *, coalesce(length(text) BETWEEN 1 AND 99 AND type <> 'table' AND last.t <> 'table' AND last.p = paragraph, false) AS joins FROM met),
placed AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY doc_id ORDER BY page, segment, part) AS chunk FROM joined WHERE joins OR lasts),
c AS (
  SELECT doc_id, chunk, first(page ORDER BY page, segment, part) AS page, first(chapter ORDER BY page, segment, part) AS chapter, first(paragraph ORDER BY page, segment, part) AS paragraph, first(type ORDER BY page, segment, part) AS type,
    string_agg(text, ' ' ORDER BY page, segment, part) AS text FROM placed GROUP BY doc_id, chunk)
SELECT doc_id, CAST(page AS INT) AS page, chapter, paragraph, type, text, CAST(chunk - 1 AS INT) AS ordinal, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS token_count FROM c"""
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_numbered(spark, sf_dir))


@_query(_sql["chunk_windows"])
def chunk_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks by a table function in SQL, a document's segments after another."""
    chunking.register(spark)
    chunking.segments(_numbered(spark, sf_dir)).createOrReplaceTempView("sedge_segments")
    called = "SELECT c.* FROM chunk_segments(TABLE(sedge_segments) PARTITION BY doc_id ORDER BY (page, segment)) c"
    return spark.sql(called).withColumn("token_count", tx.token_count(F.col("text")))


_PAGES = r"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
line AS (
  SELECT doc_id, i, i // 20 AS page, CASE WHEN i % 10 = 0 THEN 'Глава ' || (i // 10 + 1) WHEN i % 10 = 7 THEN 'Таблица ' || i || ' ' || t WHEN i % 3 = 1 THEN '5.' || i || ' ' || t ELSE t END AS t FROM raw),
page AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY i) AS text FROM line GROUP BY doc_id, page)"""


@_query(
    f"""WITH {_PAGES}
SELECT doc_id, avg(CASE WHEN length(trim(text, ' ')) > 40 THEN 1 ELSE 0 END) < 0.5 OR avg(length(trim(text, ' '))) < 80 AS is_scanned FROM page GROUP BY doc_id"""
)
def scan_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.scan_flags(_numbered(spark, sf_dir))


# ---- grounding and answers -------------------------------------------------

_SQUEEZE = r"trim(regexp_replace(replace(lower({}), 'ё', 'е'), '\s+', ' ', 'g'))"


@_query(
    rf"""WITH items AS (SELECT item_id, {_SQUEEZE.format("text")} AS q FROM benchmark WHERE length(trim(text, ' ')) >= 10), d AS (SELECT doc_id, {_SQUEEZE.format("text")} AS c FROM documents)
SELECT doc_id, count(*) AS passages, min(item_id) AS first_item FROM d JOIN items ON contains(c, q) GROUP BY doc_id"""
)
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.grounded_pairs(*_quotes(spark, sf_dir)).where("exact")
    return found.groupBy(F.col("context_id").alias("doc_id")).agg(F.count("*").alias("passages"), F.min("quote_id").alias("first_item"))


def _quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All passages of the benchmark as quotes, all documents as contexts."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return quotes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("context_id"), "text")


@_query(
    rf"""WITH q AS (SELECT item_id, {_SQUEEZE.format("text")} AS q FROM benchmark WHERE length(trim(text, ' ')) >= 10),
d AS (SELECT doc_id, {_SQUEEZE.format("text")} AS c FROM documents),
qw AS (SELECT item_id, unnest(string_split(q, ' ')) AS word, generate_subscripts(string_split(q, ' '), 1) AS j, len(string_split(q, ' ')) AS n FROM q),
dw AS (SELECT doc_id, unnest(string_split(c, ' ')) AS word, generate_subscripts(string_split(c, ' '), 1) AS i, len(string_split(c, ' ')) AS m FROM d),
near AS (
  SELECT DISTINCT doc_id, item_id FROM (
    SELECT doc_id, item_id, i - j AS start, count(*) AS hits, any_value(n) AS n, any_value(m) AS m FROM dw JOIN qw USING (word) WHERE n >= 5 GROUP BY doc_id, item_id, i - j)
  WHERE hits / n >= 0.85 AND start >= 0 AND start + n <= m),
same AS (SELECT doc_id, item_id FROM d JOIN q ON contains(c, q))
SELECT doc_id, item_id, same.doc_id IS NOT NULL AS exact, true AS grounded FROM near FULL JOIN same USING (doc_id, item_id)"""
)
def quote_grounding_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.grounded_pairs(*_quotes(spark, sf_dir))
    return found.select(F.col("context_id").alias("doc_id"), F.col("quote_id").alias("item_id"), "exact", (F.col("exact") | F.col("fuzzy")).alias("grounded"))


@_query(
    rf"""WITH b AS (SELECT item_id, list_distinct(string_split({_SQUEEZE.format("text")}, ' ')) AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct(string_split({_SQUEEZE.format("text")}, ' ')) AS c FROM documents),
n AS (SELECT item_id, doc_id, count(*) AS shared FROM (SELECT item_id, unnest(w) AS x FROM b) JOIN (SELECT doc_id, unnest(c) AS x FROM d) USING (x) GROUP BY item_id, doc_id),
s AS (SELECT item_id, doc_id, round(shared / (len(w) + len(c) - shared), 9) AS jaccard FROM n JOIN b USING (item_id) JOIN d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY jaccard DESC, doc_id) AS place FROM s)
SELECT item_id, doc_id, round(jaccard, 6) AS jaccard FROM r WHERE place = 1"""
)
def best_quote_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that shares most words with each passage, over all documents."""
    best = answers.most_similar(*_quotes(spark, sf_dir))
    return best.select(F.col("quote_id").alias("item_id"), F.col("context_id").alias("doc_id"), F.round("jaccard", 6).alias("jaccard"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("document_id").alias("id"), "number", "title", F.lit(None).cast("string").alias("paragraph"), F.lit(1).alias("page"), "text", "status")
    return lexical.top_per_query(_bm25(spark, sf_dir), 3).join(docs, "id")


@_query(
    f"""WITH {_INDEX}, {DOCUMENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 3),
h AS (SELECT query_id, rank, number, title, docs.text, status FROM r JOIN docs ON document_id = id),
c AS (
  SELECT query_id, string_agg('[' || rank || '] Документ: ' || title || ' (' || number || ')' || chr(10) || 'Пункт: —, Стр: 1, Статус: ' || status || chr(10) || 'Текст: "' || substr(text, 1, 1200) || '"', chr(10) || chr(10) ORDER BY rank) AS context
  FROM h GROUP BY query_id)
SELECT a.query_id, CASE WHEN number IS NULL THEN '{answers.NOT_FOUND}' ELSE 'Найдено релевантное требование в документе ' || number || ', пункт —. См. цитату ниже.' END AS answer,
       title AS normative_basis, substr(h.text, 1, 500) AS quote, CASE WHEN number IS NOT NULL THEN '02.01.2024' END AS date_actual, number IS NOT NULL AS is_grounded, md5(context) AS context
FROM asked a LEFT JOIN h ON h.query_id = a.query_id AND rank = 1 LEFT JOIN c ON c.query_id = a.query_id"""
)
def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    out = answers.extractive_answers(_asked(spark), hits.drop("id", "score"), F.to_date(F.lit("2024-01-02")))
    context = answers.context_blocks(hits).select("query_id", F.md5("context").alias("context"))
    return out.join(context, "query_id", "left").select("query_id", "answer", "normative_basis", "quote", "date_actual", "is_grounded", "context")


@_query(
    r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '["\\\n\r\t{}]', ' ', 'g') AS plain FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, regexp_replace(plain, ',\s*([}\]])', '\1', 'g') AS plain FROM t)
SELECT conv_id, turn, '{"answer": "' || plain || '", "pages": [1, 2]}' AS json, substr(plain, 1, 800) AS answer FROM c"""
)
def llm_output_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs made from turns: thoughts, fences and trailing commas around an answer."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    plain = F.regexp_replace("text", r'["\\\n\r\t{}]', " ")
    raw = F.concat(F.lit("<think>hm</think>```json\n{\"answer\": \""), plain, F.lit("\", \"pages\": [1, 2,],}\n``` end"))
    return answers.repaired_output(turns.select("conv_id", "turn", raw.alias("text"))).select("conv_id", "turn", "json", "answer")


@_query(
    f"""WITH {_INDEX}, {DOCUMENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 3),
h AS (SELECT query_id, rank, number, docs.text FROM r JOIN docs ON document_id = id),
s AS (
  SELECT query_id, string_agg('### ' || rank || '. ' || number || chr(10) || chr(10) || '> ' || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END, chr(10) || chr(10) ORDER BY rank) AS body
  FROM h GROUP BY query_id)
SELECT a.query_id, '# ' || a.text || chr(10) || chr(10) || 'Найдено релевантное требование в документе ' || h.number || ', пункт —. См. цитату ниже.' || chr(10) || chr(10) || body AS markdown
FROM asked a JOIN h ON h.query_id = a.query_id AND rank = 1 JOIN s ON s.query_id = a.query_id"""
)
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    out = answers.extractive_answers(_asked(spark), hits.drop("id", "score"), F.to_date(F.lit("2024-01-02")))
    return answers.markdown(out.join(_asked(spark).withColumnRenamed("text", "query"), "query_id"), hits)


# ---- usage -----------------------------------------------------------------


@_query(
    """WITH r AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS subject, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events)
SELECT request_id, subject, day, nth <= 3 AS accepted, CAST(least(nth, 3) * 10 AS INT) AS used FROM r"""
)
def daily_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily_credits(requests(spark, sf_dir)).select("request_id", "subject", "day", "accepted", "used")


@_query(
    """WITH r AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type = 'view')
SELECT subject, count(*) FILTER (WHERE nth <= 10) AS accepted, count(*) FILTER (WHERE nth > 10) AS rejected, max(request_id) FILTER (WHERE nth <= 10) AS last_accepted FROM r GROUP BY subject"""
)
def lifetime_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = usage.lifetime_quota(requests(spark, sf_dir).where("event_type = 'view'"), 10)
    return judged.groupBy("subject").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.max(F.when(F.col("accepted"), F.col("request_id"))).alias("last_accepted"))


@_query(
    """SELECT CAST(user_id AS VARCHAR) AS subject, date_trunc('hour', ts) AS start, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY 1, 2"""
)
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.rate_limits(requests(spark, sf_dir), 2).withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS subject, count(*) AS count FROM events GROUP BY 1, 2),
old AS (SELECT day, subject, count FROM d WHERE day < DATE '2024-01-15' UNION ALL SELECT day, subject, 10 FROM d)
SELECT day, subject, CAST(sum(count) AS BIGINT) AS count FROM old GROUP BY 1, 2"""
)
def usage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = requests(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "subject").agg(F.count("*").alias("count"))
    return usage.add_usage(day.where("day < DATE '2024-01-15'"), day.withColumn("count", F.lit(10).cast("bigint")))


@_query("""SELECT date_trunc('day', ts) AS start, CAST(user_id AS VARCHAR) AS subject, count(*) AS n FROM events GROUP BY 1, 2""")
def usage_stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events, read to its end; closed and last windows (complete mode)."""
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    rows = jobs.usage_windows(source.select(F.col("user_id").cast("string").alias("subject"), "ts"))
    out = jobs.run_to_end(rows, shared_path(spark, "usage"), shared_path(spark, "usage-state"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query(
    f"""WITH {LOG_SQL}, c AS (SELECT lower(trim(text, ' ')) AS key, arg_min(text, ts) AS text, count(*) AS n, max(ts) AS last FROM log WHERE trim(text, ' ') <> '' GROUP BY 1)
SELECT * FROM c ORDER BY last DESC, key LIMIT 200"""
)
def query_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.query_popularity(query_log(spark, sf_dir))


@_query(
    f"""WITH {LOG_SQL}, n AS (SELECT user_id, lower(trim(text, ' ')) AS key, count(*) AS n, min(ts) AS first FROM log GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, key) AS place FROM n)
SELECT user_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_queries, max(CASE WHEN place = 1 THEN key END) AS favourite FROM r GROUP BY user_id"""
)
def personal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.personal_statistics(query_log(spark, sf_dir))


@_query(
    f"""WITH {LOG_SQL}, l AS (SELECT user_id, text, max(ts) AS ts FROM log GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, text) AS place FROM l)
SELECT user_id, text, ts, CAST(place AS INT) AS place FROM r WHERE place <= 12"""
)
def recent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.recent(query_log(spark, sf_dir), ["user_id"], "text")
    return out.withColumn("place", F.col("place").cast("int"))


# ---- text ------------------------------------------------------------------


@_query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)(tion|the)')) AS marks, md5(regexp_replace(text, '(?i)(tion|the)', '<mark>\1</mark>', 'g')) AS marked FROM documents"""
)
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(text, F.lit("(?i)(tion|the)")).cast("bigint").alias("marks"), F.md5(tx.highlight(text, ["the", "tion"])).alias("marked"))


@_query(
    f"""WITH {DOCUMENTS_SQL}
SELECT document_id, CASE status WHEN 'active' THEN 'Действует' WHEN 'replaced' THEN 'Заменён' WHEN 'expired' THEN 'Утратил силу' ELSE status END AS label, 'НТД' AS kind,
       substr(regexp_replace(title, '[^a-zA-Z0-9à-ÿÀ-ÿ_.-]', '_', 'g'), 1, 50) AS file, substr(checksum, 1, 4) || '…' || substr(checksum, 61, 4) AS masked FROM docs"""
)
def type_and_status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("document_id", tx.status_label(F.col("status")).alias("label"), tx.document_type(F.col("number")).alias("kind"), tx.safe_name(F.col("title")).alias("file"), tx.mask(F.col("checksum")).alias("masked"))


@_query(f"""WITH {_INT8} SELECT vec_id AS id, CAST(scale AS FLOAT)::DOUBLE AS scale, CAST(list_sum(q) AS BIGINT) AS total, CAST(q[1] AS INT) AS first, CAST(q[len(q)] AS INT) AS last FROM qz""")
def snv1_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = vx.quantize(_unit(spark, sf_dir).where("v is not null"), "v").select("id", F.col("scale").cast("float").alias("scale"), "q")
    path = shared_path(spark, "snv1")
    vector_files.register(spark)
    z.write.format("snv1").mode("append").save(path)
    back = spark.read.format("snv1").load(path)
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    ends = [F.element_at("q", i).cast("int").alias(name) for i, name in ((1, "first"), (-1, "last"))]
    return back.select("id", F.col("scale").cast("double").alias("scale"), total.alias("total"), *ends)
