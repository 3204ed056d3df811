"""The inverted index and lexical scores.

Index tables are long: postings(term, id, tf), lengths(id, dl) and one row of
statistics.  Queries come as a table (query_id, terms), so a single query is a
batch of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profiles import Profile
from ..functions.text import kept_token, raw_tokens, stem, tokenize
from ..sources.staging import staged

K1, B = 1.2, 0.75
#: Terms of a query batch, or similar narrow rows, that go to every task; more are left to a shuffle.
MAX_BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if it is counted to have at most `most` rows (of some 100 bytes)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tokenized(chunks: DataFrame, profile: Profile, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, tokens): a row's tokens in order, for what needs their places."""
    return chunks.select(F.col(id_col).alias("id"), tokenize(F.col(text_col), profile).alias("tokens"))


def occurrences(chunks: DataFrame, profile: Profile, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term): a row for each token; term is null for a dropped one, and once for a row without any.

    Tokens are exploded before they are judged, so stopwords and stems are
    plain expressions of generated code and not functions over arrays.  Rows
    with a null id are not indexed.
    """
    rows = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode_outer(raw_tokens(F.col(text_col), profile)).alias("raw"))
    rows = rows.select("id", F.when(kept_token(F.col("raw"), profile), stem(F.col("raw"), profile)).alias("term"))
    return rows.select("id", F.when(kept_token(F.col("term"), profile), F.col("term")).alias("term"))


def counted(occurrences_: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(id, term, tf): a row for each term of a row of text; '' stands for dropped tokens.

    With `terms` (term), only those keep their name and all others add up
    under '': what a query needs of a corpus, from one pass over it.
    """
    rows = occurrences_
    if terms is not None:
        asked = small(terms.select(F.col("term").alias("asked")).distinct())
        rows = rows.join(asked, rows["term"] == asked["asked"], "left").select("id", "asked", F.col("term").isNotNull().cast("long").alias("one"))
        return rows.groupBy("id", F.coalesce("asked", F.lit("")).alias("term")).agg(F.sum("one").alias("tf"))
    return rows.groupBy("id", F.coalesce("term", F.lit("")).alias("term")).agg(F.count("term").alias("tf"))


def row_counts(chunks: DataFrame, profile: Profile, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, id, term, tf): the terms of each row of text, counted within the row, in order of terms.

    Nothing is shuffled and rows stay where they are: equal terms stand
    together in the sorted tokens, so a term's count is the distance from its
    first place to the next term's.  Rows that share an id are not added up,
    and those with a null id not indexed.  Rows without terms leave after the
    outer inline: a filter before it would be pushed down and tokenise twice.
    """
    places = F.when(F.size("_tokens") > 0, F.sequence(F.lit(0), F.size("_tokens") - 1))
    first = F.filter(places, lambda i: (i == 0) | (F.get("_tokens", i) != F.get("_tokens", i - 1)))
    terms = F.transform("_first", lambda i, k: F.struct(F.get("_tokens", i).alias("term"), (F.coalesce(F.get("_first", k + 1), F.size("_tokens")) - i).cast("long").alias("tf")))
    rows = chunks.where(F.col(id_col).isNotNull()).select(*keep, F.col(id_col).alias("id"), F.sort_array(tokenize(F.col(text_col), profile)).alias("_tokens"))
    return rows.withColumn("_first", first).select(*keep, "id", F.inline_outer(terms)).where("term is not null")


def postings(counted_: DataFrame) -> DataFrame:
    """(term, id, tf) of counted rows.  The condition is on the sum too, so that
    lengths and postings share the shuffle below it."""
    return counted_.where(F.when(F.col("tf") > 0, F.col("term") != "")).select("term", "id", "tf")


def lengths(counted_: DataFrame) -> DataFrame:
    """(id, dl): the tokens of every row, 0 included."""
    return counted_.groupBy("id").agg(F.sum("tf").alias("dl"))


def statistics(lengths_: DataFrame) -> DataFrame:
    """One row: n and avgdl, the mean length rounded to two places."""
    return lengths_.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg("dl"), 2), F.lit(0.0)).alias("avgdl"))


def posting_rows(chunks: DataFrame, profile: Profile, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf): the postings of all rows of text, written once for what reads them several times.

    Where no two rows share an id, a row's counts are whole and nothing is
    grouped or shuffled; else they are added up over the rows of an id.
    """
    shared = chunks.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if shared.isEmpty():
        return staged(row_counts(chunks, profile, id_col, text_col).select("term", "id", "tf"), "postings")
    return staged(postings(counted(occurrences(chunks, profile, id_col, text_col))), "postings")


def _pieces(size: int):
    """Rows sorted by term as pieces (term, place, list): up to `size` entries of a term, `place` entries of it before them."""

    def piece(rows: pa.RecordBatch, cuts: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """The pieces between neighbouring cuts."""
        entries = pa.StructArray.from_arrays([rows.column("id"), rows.column("tf")], names=["id", "tf"])
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), entries)
        return pa.RecordBatch.from_arrays([rows.column("term").take(pa.array(cuts[:-1])), pa.array(place[cuts[:-1]]), lists], names=["term", "place", "list"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # the piece that the next rows may go on, and the entries of its term before it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            term = rows.column("term")
            fresh = np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False))
            start = np.flatnonzero(fresh)
            place = np.arange(len(term)) - np.repeat(start, np.diff(np.append(start, len(term))))
            place[: start[1] if len(start) > 1 else None] += done
            cuts = np.flatnonzero(fresh | (place % size == 0))
            if len(cuts) > 1:
                yield piece(rows, cuts, place)
            held, done = rows.slice(cuts[-1]), int(place[cuts[-1]])
        if held is not None:
            yield piece(held, np.array([0, held.num_rows]), np.array([done]))

    return run


def posting_segments(postings_: DataFrame, size: int = 4096) -> DataFrame:
    """(term, segment, n, list): postings of a term in order of id, cut into segments of `size` entries.

    Postings are dealt by range of term and id, so a term of all texts is no
    single group.  A part's sorted rows are cut into pieces as they pass; those
    of a term that stands in one part alone are its segments.  Of a term in
    several parts (at most two of a part are), the pieces are moved by the
    entries in the parts before, which cuts each in two at most, and put
    together by segment.
    """
    kind = dict(postings_.dtypes)
    dealt = postings_.select("term", "id", "tf").repartitionByRange("term", "id").sortWithinPartitions("term", "id")
    pieces = dealt.mapInArrow(_pieces(size), f"term string, place long, list array<struct<id: {kind['id']}, tf: {kind['tf']}>>")
    pieces = staged(pieces.withColumn("_part", F.spark_partition_id()), "pieces")
    counts = pieces.groupBy("term", "_part").agg(F.sum(F.size("list")).alias("_n"))
    of_term = Window.partitionBy("term")
    before = F.sum("_n").over(of_term.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    cut = counts.withColumn("_ahead", F.coalesce(before, F.lit(0))).withColumn("_parts", F.count("*").over(of_term)).where("_parts > 1")
    cut = F.broadcast(staged(cut.select("term", "_part", "_ahead"), "cut"))  # at most two rows a part
    segment = lambda place: F.floor(place / size).cast("long").alias("segment")
    whole = pieces.join(cut.select("term").distinct(), "term", "left_anti").select("term", segment(F.col("place")), "list")
    begin = F.col("place") + F.col("_ahead")
    room = (size - begin % size).cast("int")
    halves = F.array(
        F.struct(segment(begin), F.slice("list", F.lit(1), room).alias("list")), F.struct((segment(begin) + 1).alias("segment"), F.slice("list", room + 1, F.lit(size)).alias("list"))
    )
    moved = pieces.join(cut, ["term", "_part"]).select("term", F.inline(halves)).where(F.size("list") > 0)
    moved = moved.groupBy("term", "segment").agg(F.sort_array(F.flatten(F.collect_list("list"))).alias("list"))
    return whole.unionByName(moved).select("term", "segment", F.size("list").cast("long").alias("n"), "list")


def query_terms(queries: DataFrame, profile: Profile, text_col: str = "text") -> DataFrame:
    """(query_id, term): the distinct terms of each query."""
    terms = F.array_distinct(tokenize(F.col(text_col), profile))
    return queries.select("query_id", F.explode(terms).alias("term"))


def bm25(terms: DataFrame, postings_: DataFrame, lengths_: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score): sums over the distinct terms of each query."""
    terms = small(terms)
    asked = postings_.join(small(terms.select("term").distinct()), "term", "left_semi")
    df = asked.groupBy("term").agg(F.count("*").alias("df"))
    hits = asked.join(terms, "term").join(df, "term").join(lengths_, "id").crossJoin(F.broadcast(stats))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    dl = F.when(F.col("dl") == 0, F.col("avgdl")).otherwise(F.col("dl"))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * dl / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.sum(idf * weight).alias("score"))


def top_per_query(scores: DataFrame, k: int, score: str = "score", partition: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller id."""
    by = Window.partitionBy(*partition).orderBy(F.desc(score), "id")
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def match_all(terms: DataFrame, postings_: DataFrame) -> DataFrame:
    """(query_id, id) of the rows that hold every term of a query."""
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("wanted"))
    found = postings_.join(small(terms), "term").groupBy("query_id", "id").agg(F.count("*").alias("found"))
    return found.join(wanted, "query_id").where("found = wanted").select("query_id", "id")


def cover_density(tokens: DataFrame, terms: list[str], weight: float = 0.1) -> DataFrame:
    """(id, score): over the minimal covers of all terms, the sum of weight / (1 + noise).

    The rank of full-text search by how close the terms stand; noise are the
    tokens of a cover that are no terms, `weight` is that of unlabelled text.
    Positions of each row are swept once, in the row's own array.
    """
    places = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(terms))
    places = F.transform(places, lambda x, n: F.struct(x["t"].alias("t"), x["i"].alias("i"), n.alias("n")))
    rows = tokens.select("id", places.alias("p")).where(F.size("p") >= len(terms))
    none = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("n"))
    start = F.struct(F.array(*(none for _ in terms)).alias("last"), F.lit(-1).alias("from_"), F.lit(0.0).cast("double").alias("score"))

    def step(state: Column, x: Column) -> Column:
        here = F.struct(x["i"].alias("i"), x["n"].alias("n"))
        now = F.transform(state["last"], lambda at, k: F.when(F.element_at(F.array(*map(F.lit, terms)), k + 1) == x["t"], here).otherwise(at))
        low = F.array_min(now)
        fresh = (low["i"] >= 0) & (low["i"] > state["from_"])
        noise = (x["i"] - low["i"]) - (x["n"] - low["n"])
        gain = F.when(fresh, weight / (1 + noise)).otherwise(0.0)
        return F.struct(now.alias("last"), F.when(fresh, low["i"]).otherwise(state["from_"]).alias("from_"), (state["score"] + gain).alias("score"))

    return rows.select("id", F.aggregate("p", start, step)["score"].alias("score")).where("score > 0")
