"""Quote grounding, answer assembly, repair of model output, export."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..sources.staging import staged
from .grams import rarest
from .lexical import small

# Phrases and messages of answers.
NOT_FOUND_PHRASES = ("не найдено", "не содержится", "нет информации", "не предоставлено", "не содержит", "не найден")
NOT_FOUND = "В доступной нормативной базе точного требования не найдено."


def grounded_exact(quote: Column, context: Column) -> Column:
    """A quote of ten characters or more stands in the context, ё as е."""
    return F.coalesce((F.length(F.trim(quote)) >= 10) & F.contains(tx.squeeze(context), tx.squeeze(quote)), F.lit(False))


def grounded(quote: Column, context: Column, threshold: float = 0.85) -> Column:
    """Exactly grounded, or five words or more of which enough stand in order."""
    words = F.struct(F.split(tx.squeeze(quote), " ").alias("q"), F.split(tx.squeeze(context), " ").alias("c"))

    def enough(s: Column) -> Column:
        q, c = s["q"], s["c"]
        hits = lambda i: F.size(F.filter(F.zip_with(q, F.slice(c, i, F.size(q)), lambda a, b: a == b), lambda same: same))
        fits = F.exists(F.sequence(F.lit(1), F.size(c) - F.size(q) + 1), lambda i: hits(i) / F.size(q) >= threshold)
        return (F.size(q) >= 5) & (F.size(c) >= F.size(q)) & fits

    fuzzy = F.transform(F.array(words), enough)[0]  # words are split once, not for each window
    return F.when(grounded_exact(quote, context), True).otherwise(F.coalesce((F.length(F.trim(quote)) >= 10) & fuzzy, F.lit(False)))


def grounded_pairs(quotes: DataFrame, contexts: DataFrame, threshold: float = 0.85, least: int = 10) -> DataFrame:
    """(quote_id, context_id, exact, fuzzy) of every quote that a context grounds.

    All of quotes (quote_id, text) meet all of contexts (context_id, text)
    without a cross join: a quote of n words that matches in place but for the
    share that the threshold forgives has, of one block of words more than may
    differ, one that matches whole, and the first three words of each block
    are keys.  The second to fourth words are the key of an exact match, whose
    first and last words may be parts of words.  Quotes under five words are
    only matched exactly, by their first characters at every place of a text.
    """
    key = lambda words, i: F.xxhash64(F.slice(words, i, 3))
    asked = quotes.where(F.length(F.trim("text")) >= least).select("quote_id", tx.squeeze(F.col("text")).alias("q"))
    asked = asked.withColumn("qw", F.split("q", " ")).withColumn("n", F.size("qw"))
    texts = contexts.select("context_id", tx.squeeze(F.col("text")).alias("c"))
    texts = texts.withColumn("cw", F.split("c", " "))

    size = F.floor(F.col("n") / (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)).cast("int")
    starts = F.sequence(F.lit(0), F.col("n") - size, size)
    long = asked.where("n >= 5").select("quote_id", "qw", F.explode(F.array_union(F.array(F.lit(1)), starts)).alias("at"))
    keys = small(long.select("quote_id", "at", key(F.col("qw"), F.col("at") + 1).alias("key")))
    grams = F.transform(F.sequence(F.lit(1), F.size("cw") - 2), lambda i: key(F.col("cw"), i))
    held = texts.where(F.size("cw") >= 3).select("context_id", F.posexplode(grams).alias("pos", "key"))
    met = held.join(keys, "key").select("quote_id", "context_id", (F.col("pos") - F.col("at")).alias("start")).distinct()

    few = asked.where("n < 5").withColumn("size", F.least(F.length("q"), F.lit(8)))
    sizes = F.broadcast(few.select("size").distinct())  # eight at most
    chars = F.transform(F.sequence(F.lit(1), F.length("c")), lambda i: F.xxhash64(F.substr("c", i, F.col("size"))))
    chars = texts.where("c <> ''").crossJoin(sizes).select("context_id", "size", F.explode(F.array_distinct(chars)).alias("key"))
    brief = few.select("quote_id", "size", F.xxhash64(F.substr("q", F.lit(1), F.col("size"))).alias("key"))
    met = met.unionByName(chars.join(brief, ["size", "key"]).select("quote_id", "context_id", F.lit(-1).alias("start")))

    both = met.join(texts, "context_id").join(asked, "quote_id")
    fits = (F.col("n") >= 5) & (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("cw"))
    in_place = F.zip_with("qw", F.slice("cw", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n")), lambda a, b: a == b)
    hits = F.size(F.filter(in_place, lambda same: same))
    judged = both.select("quote_id", "context_id", F.contains("c", "q").alias("exact"), (fits & (hits / F.col("n") >= threshold)).alias("fuzzy"))
    return judged.groupBy("quote_id", "context_id").agg(F.bool_or("exact").alias("exact"), F.bool_or("fuzzy").alias("fuzzy")).where("exact or fuzzy")


def set_candidates(asked: DataFrame, held: DataFrame, index: DataFrame, first: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two lists of pairs (quote_id, context_id, jaccard) that hold all best pairs.

    asked: quote_id, w (distinct words), n; held: context_id, w, m; index:
    (gram, id), the contexts of each word.  The first list has the contexts of
    each quote's `first` rarest words.  Its best similarity is a bar: a context
    that reaches it has one of the n - ceil(bar * n) + 1 rarest words and
    between bar * n and n / bar words, so the second list has the contexts of
    the further words up to there.
    """
    each = asked.select("quote_id", "n", F.explode("w").alias("gram"))
    words = rarest(each, index, ["quote_id", "n"])
    none = words.groupBy("quote_id").agg(F.count(F.when(F.col("df") == 0, 1)).alias("none"))
    words = staged(words.where("df > 0").join(none, "quote_id"), "words")

    def measured(pairs: DataFrame) -> DataFrame:
        both = pairs.join(asked.select("quote_id", F.col("w").alias("qw"), "n"), "quote_id").join(held.select("context_id", F.col("w").alias("cw"), "m"), "context_id")
        shared = F.size(F.array_intersect("qw", "cw"))
        return both.select("quote_id", "context_id", F.round(shared / (F.col("n") + F.col("m") - shared), 9).alias("jaccard"))

    met = index.join(words.where(F.col("place") < F.col("none") + first).select("quote_id", "gram"), "gram")
    rare = staged(measured(met.select("quote_id", F.col("id").alias("context_id")).distinct()), "pairs")
    bar = rare.groupBy("quote_id").agg(F.max("jaccard").alias("bar"))
    more = words.where(F.col("place") >= F.col("none") + first).join(bar, "quote_id")
    more = more.where(F.col("place") <= F.col("n") - F.ceil((F.col("bar") - 1e-8) * F.col("n"))).select("quote_id", "gram", "n", "bar")
    sizes = held.select(F.col("context_id").alias("id"), "m")
    met = index.join(more, "gram").join(sizes, "id").where((F.col("m") >= (F.col("bar") - 1e-8) * F.col("n")) & (F.col("m") * (F.col("bar") - 1e-8) <= F.col("n")))
    pairs = met.select("quote_id", F.col("id").alias("context_id")).distinct().join(rare, ["quote_id", "context_id"], "left_anti")
    return rare, measured(pairs)


def most_similar(quotes: DataFrame, contexts: DataFrame) -> DataFrame:
    """(quote_id, context_id, jaccard): of all contexts the one that shares most words with each quote.

    Only contexts of a quote's rarest words are compared, as far as the best
    similarity so far allows another one to reach it; ties go to the smaller
    id.  Quotes that share no word with any context are left out.
    """
    words = lambda c: F.array_distinct(F.split(tx.squeeze(c), " "))
    asked = staged(quotes.select("quote_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")), "asked")
    held = staged(contexts.select("context_id", words(F.col("text")).alias("w")).withColumn("m", F.size("w")), "held")
    known = small(asked.select(F.explode("w").alias("gram")).distinct())
    index = staged(held.select(F.col("context_id").alias("id"), F.explode("w").alias("gram")).join(known, "gram", "left_semi"), "index")
    rare, more = set_candidates(asked, held, index)
    best = F.max_by(F.struct("context_id", "jaccard"), F.struct("jaccard", -F.col("context_id")))
    return rare.unionByName(more).groupBy("quote_id").agg(best.alias("best")).select("quote_id", "best.*")


def strict_grounded(quote: Column, context: Column, said: Column) -> Column:
    """Substring grounding; without a quote the model's own flag counts."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.when(F.coalesce(F.trim(quote), F.lit("")) == "", F.coalesce(said, F.lit(False))).otherwise(F.contains(plain(context), plain(quote)))


def snippet(text: Column, size: int = 500, least: int = 200) -> Column:
    """The first `size` characters, cut after the last sentence beyond `least`."""
    head = F.substring(text, 1, size)
    stop = F.length(head) - F.locate(" .", F.reverse(head))  # position of the last ". ", from 1
    cut = (F.locate(" .", F.reverse(head)) > 0) & (stop - 1 > least)
    return F.trim(F.when(cut, F.substr(head, F.lit(1), stop)).otherwise(head))


def best_quotes(quotes: DataFrame, contexts: DataFrame, least: float = 0.15) -> DataFrame:
    """(query_id, jaccard, pos, quote): the context that shares most words.

    quotes (query_id, quote) meet the contexts (query_id, pos, text) of their
    query; of equal ones the first counts.  Below `least` the first context
    stands in.
    """
    words = lambda c: F.array_distinct(F.split(tx.squeeze(c), " "))
    scored = contexts.join(quotes, "query_id").withColumn("jaccard", F.round(tx.jaccard(words(F.col("quote")), words(F.col("text"))), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("jaccard"), "pos")
    best = scored.withColumn("place", F.row_number().over(order)).where("place = 1")
    first = contexts.groupBy("query_id").agg(F.trim(F.substring(F.min_by("text", "pos"), 1, 500)).alias("head"))
    chosen = F.when(F.col("jaccard") > least, snippet(F.col("text"))).otherwise(F.col("head"))
    return best.join(first, "query_id").select("query_id", "jaccard", "pos", chosen.alias("quote"))


def context_blocks(hits: DataFrame, most: int = 3, size: int = 1200) -> DataFrame:
    """(query_id, context): numbered blocks of the best hits for a prompt."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    # The labels of a block.
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] Документ: "), F.coalesce("title", "number", F.lit("Документ")), F.lit(" ("), dash("number"), F.lit(")\nПункт: "),
        dash("paragraph"), F.lit(", Стр: "), dash("page"), F.lit(", Статус: "), F.coalesce("status", F.lit("действует")), F.lit('\nТекст: "'), F.substring(F.coalesce("text", F.lit("")), 1, size), F.lit('"'),
    )
    rows = hits.where(F.col("rank") <= most).select("query_id", "rank", block.alias("block"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def is_not_found(answer: Column, quote: Column) -> Column:
    said = F.lit(False)
    for phrase in NOT_FOUND_PHRASES:
        said = said | F.lower(answer).contains(phrase)
    return F.coalesce(said, F.lit(False)) | F.coalesce(F.lower(quote).contains("не найдено"), F.lit(False))


def extractive_answers(queries: DataFrame, hits: DataFrame, today: Column) -> DataFrame:
    """The answer without a model: the best hit of each query, or a message.

    hits: query_id, rank, number, title, paragraph, page, text, status.
    """
    top = hits.where("rank = 1").drop("rank")
    found = F.col("number").isNotNull()
    said = F.concat(F.lit("Найдено релевантное требование в документе "), "number", F.lit(", пункт "), F.coalesce("paragraph", F.lit("—")), F.lit(". См. цитату ниже."))
    return queries.select("query_id").join(top, "query_id", "left").select(
        "query_id", F.when(found, said).otherwise(NOT_FOUND).alias("answer"), F.coalesce("title", "number").alias("normative_basis"), "paragraph", "page",
        F.substring("text", 1, 500).alias("quote"), "status", F.when(found, F.date_format(today, "dd.MM.yyyy")).alias("date_actual"), found.alias("is_grounded"),
    )


def checked_answers(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Model answers held against their hits.

    answers: query_id, answer, paragraph, page, quote.  A clause that no hit
    has and a page outside 1..5000 are replaced by the best hit's; a quote
    that no hit grounds is replaced, and both flags are kept.
    """
    top = hits.where("rank = 1").select("query_id", F.col("paragraph").alias("top_paragraph"), F.col("page").alias("top_page"))
    seen = hits.groupBy("query_id").agg(F.collect_set("paragraph").alias("known"))
    every = hits.select("query_id", F.col("rank").alias("pos"), "text")
    quoted = answers.where("quote is not null").select("query_id", "quote")
    supported = every.join(quoted, "query_id").groupBy("query_id").agg(F.bool_or(grounded(F.col("quote"), F.col("text"))).alias("quote_was_grounded"))
    better = best_quotes(quoted, every).select("query_id", F.col("quote").alias("better"))
    out = answers.join(top, "query_id", "left").join(seen, "query_id", "left").join(supported, "query_id", "left").join(better, "query_id", "left")
    known = F.coalesce(F.size("known"), F.lit(0)) == 0
    out = out.withColumn("paragraph", F.when(known | F.array_contains("known", F.col("paragraph")), F.col("paragraph")).otherwise(F.col("top_paragraph")))
    out = out.withColumn("page", F.when(F.col("page").between(1, 5000), F.col("page")).otherwise(F.col("top_page")))
    was = F.coalesce("quote_was_grounded", F.lit(False))
    out = out.withColumn("quote_repaired", F.col("quote").isNotNull() & ~was)
    out = out.withColumn("not_found", is_not_found(F.col("answer"), F.col("quote")))
    out = out.withColumn("quote", F.when(F.col("quote_repaired"), F.col("better")).otherwise(F.col("quote")))
    out = out.withColumn("answer", F.when(F.col("not_found"), NOT_FOUND).otherwise(F.substring("answer", 1, 800)))
    return out.withColumn("quote_was_grounded", was).drop("top_paragraph", "top_page", "known", "better")


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text, strings and escapes respected."""
    depth, start, quoted, escaped = 0, -1, False, False
    for i, c in enumerate(text or ""):
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(T.StringType())
def balanced_json(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)


def repaired_output(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """`texts` with json (the object a model's output holds) and answer from it or from the text."""
    clean = tx.without_fences(F.col(text_col))
    out = texts.withColumn("clean", clean).withColumn("json", balanced_json("clean"))
    loose = F.nullif(F.regexp_extract("clean", r'(?s)"answer"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    return out.withColumn("answer", F.substring(F.coalesce(F.get_json_object("json", "$.answer"), loose, F.col("clean")), 1, 800)).drop("clean")


def markdown(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, markdown): the answer and a section for each hit, texts cut to 500."""
    text = F.coalesce("text", F.lit(""))
    cut = F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("…"))).otherwise(text)
    section = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), F.coalesce("number", F.lit("—")), F.lit("\n\n> "), cut)
    rows = hits.select("query_id", "rank", section.alias("section")).groupBy("query_id")
    body = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]), "\n\n").alias("body"))
    head = F.concat(F.lit("# "), "query", F.lit("\n\n"), "answer", F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return answers.join(body, "query_id", "left").select("query_id", head.alias("markdown"))
