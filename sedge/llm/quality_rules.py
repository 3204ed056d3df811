"""Quality rules: counts of each text, and line frequency across documents.

A line that more documents of a host carry than the limits allow is taken for
boilerplate; documents that lose too much with those lines are rejected.  All
counting is done in DataFrame operations: lines travel as hashes, a line or a
host with a third of all rows is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import counted, materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """use(value), with `value` computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, size: int = 8) -> Column:
    """Words in windows of `size` words that are found twice or more in a text.

    Windows are compared by 64-bit hashes; only texts that have equal ones sort
    their windows, and the positions are merged in one pass over the sorted.
    """

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.get(s, k)["h"] == x["h"]
            hit = F.filter(s, lambda x, k: F.coalesce((k > 0) & same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
            places = F.sort_array(F.transform(hit, lambda x: x["i"]))
            add = lambda p: F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(size)), F.lit(size)))
            return F.aggregate(_let(places, add), F.lit(0), lambda a, x: a + x)

        found = _let(F.sort_array(pairs), twice)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(0)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > size, _let(_let(hashed, windows), count)).otherwise(0).cast("long")


def text_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a column.

    Columns `q_words` and `q_lines` must hold words_of(text) and the lines of
    the text that have a word.
    """
    whole = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size("q_words").cast("long"),
        "word_chars": F.char_length(F.regexp_replace(whole, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("q_words")),
    }


def lines_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def frequent_lines(docs: DataFrame, host: Column, id_col: str, text_col: str, max_docs: int, max_share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(lines, frequent): the hashed lines of rows (id, q_row, host, pos, line, n),
    and the (host, line) that more than max_docs documents and more than
    max_share of the host's documents carry.  Documents are distinct ids."""
    entry = F.transform(lines_of(F.col(text_col)), lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    lines = docs.select(F.col(id_col).alias("id"), "q_row", host.alias("host"), F.posexplode(entry).alias("pos", "x"))
    lines = lines.select("id", "q_row", "host", "pos", "x.line", "x.n")
    carried = lines.groupBy("host", "line").agg(F.count_distinct("id").alias("docs")).where(F.col("docs") > max_docs)
    hosts = docs.select(host.alias("host"), F.col(id_col).alias("id")).groupBy("host").agg(F.count_distinct("id").alias("all_docs"))
    over = F.col("docs") * max_share[1] > F.col("all_docs") * max_share[0]
    return lines, carried.join(hosts, "host").where(over).select("host", "line")


def quality_rules(
    docs: DataFrame,
    host_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int = 20,
    max_share: tuple[int, int] = (5, 100),
    min_words: int = 20,
    max_repeat: tuple[int, int] = (30, 100),
    min_left: tuple[int, int] = (30, 100),
) -> DataFrame:
    """doc_id, the counts of text_counts, n_frequent_words, base_failed, kept of every row.

    base_failed: fewer than min_words words, or more than max_repeat of the
    words in repeated windows.  A row is kept if it did not fail and, without
    the lines above the limits (max_docs documents and max_share of the
    host's documents), min_words words and min_left of its words are left.

    Null texts count as empty: they fail.  A null host is a host of its own.
    Rows with a null id are judged, but their lines count for no document.
    Repeated rows are returned as often as they come and count once.  An empty
    table gives an empty result, a text of any length is counted whole, and
    other columns don't matter, whatever their names.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), host.alias("q_host"))
    docs = docs.withColumn("q_row", F.xxhash64("doc_id", "text", "q_host"))
    lines, frequent = frequent_lines(docs, F.col("q_host"), "doc_id", "text", max_docs, max_share)
    # frequent lines are hot keys by their nature: they go to the lines, so that no line's rows meet in one task
    frequent = counted(materialize(frequent, "frequent"))
    lost = lines.join(frequent, ["host", "line"]).dropDuplicates(["id", "q_row", "pos"]).groupBy("id", "q_row").agg(F.sum("n").alias("n_frequent_words"))
    judged = docs.withColumns({"q_words": words_of(F.col("text")), "q_lines": lines_of(F.col("text"))})
    judged = judged.select("doc_id", "q_row", *(c.alias(n) for n, c in text_counts(F.col("text")).items()))
    out = judged.join(lost, (F.col("doc_id").eqNullSafe(F.col("id"))) & (judged["q_row"] == lost["q_row"]), "left").drop("id").drop("q_row")
    out = out.withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (max_repeat[1] * F.col("n_repeat_words") > max_repeat[0] * F.col("n_words"))
    left = F.col("n_words") - F.col("n_frequent_words")
    enough = (F.col("n_frequent_words") == 0) | ((left >= min_words) & (left * min_left[1] >= F.col("n_words") * min_left[0]))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & enough)
