"""A training-corpus pipeline over `documents`, each stage one operator.

Every stage but the last returns the columns of its input; its decisions take
effect on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import mixing
from sedge.llm.language_id import UNKNOWN, identify_languages
from sedge.llm.near_dedup import near_duplicates
from sedge.llm.packing import pack
from sedge.llm.queries import vocabulary
from sedge.llm.scratch import anti_reduce, materialize, tidied
from sedge.llm.substring_dedup import remove_repeats
from sedge.plans.tables import table

#: A predicted language needs this calibrated probability.
MIN_SCORE = 0.5


def _marked(docs: DataFrame) -> DataFrame:
    """All columns as d_*, so that no column of `docs` clashes with an operator's."""
    return docs.select(*(F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns))


def _plain(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(f"`d_{c}`").alias(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; a missing `lang` is filled in.

    So go null texts and texts without a letter, and, if no row has a language
    to learn from, all.  Repeated rows and rows with a null id are judged by
    their text; an empty table stays empty, texts of any length are read whole.
    """
    judged = identify_languages(_marked(docs), "d_doc_id", "d_text", "d_lang")
    judged = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= MIN_SCORE))
    return _plain(judged.withColumn("d_lang", F.coalesce("d_lang", "lang_pred")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group stays.

    Five-word shingles, similarity 0.8 or more.  Of rows with one id one stays;
    rows with a null id, null or empty texts link nothing and stay.  An empty
    table stays empty, texts of any length are compared whole.
    """
    with tidied() as keep:
        found = keep(materialize(near_duplicates(docs), "near"))
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    kept = anti_reduce(docs, gone, "doc_id", gone.count())
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    n_again = again.count()
    if n_again:
        one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = anti_reduce(kept, again, "doc_id", n_again).unionByName(one)
    return kept.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only in the document of least id.

    A document may become empty, none goes.  Null texts, rows with a null id,
    rows that share an id and an empty table are as in `remove_repeats`.
    """
    rest = tuple(f"d_{c}" for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = remove_repeats(_marked(docs), "d_doc_id", "d_text", keep=rest)
    cut = cut.withColumnsRenamed({"doc_id": "d_doc_id", "text": "d_text"})
    return _plain(cut.withColumn("d_n_chars", F.char_length("d_text").cast("long")), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """80 % of all tokens by the weights of domains and languages.

    One epoch: a second one would bring back exact copies.  A null text has no
    tokens, a null `lang` or `source` counts as '', rows with one id stand or
    fall together.  An empty table stays empty.
    """
    tree = mixing.documents_tree("d_lang", "d_source")
    mixed = mixing.mix_sources(_marked(docs), tree, mixing.DOCUMENTS_WEIGHTS, max_epochs=1, id_col="d_doc_id", text_col="d_text")
    return _plain(mixed.where("mix_copies > 0"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset.

    A null text is empty and still has a piece, as has each repeated row; an
    empty table gives an empty result.
    """
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with tidied() as keep:  # what a stage wrote on its way goes when its result is written
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
