"""The registered queries of this subpackage and their SQL.

A query reads the whole tables of `sf_dir`, applies one operator with its
production parameters and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table as _table
from ..sources.staging import shared_path
from . import mixing
from .archives import archived_pages, page_records, write_archive
from .conversation_repair import damaged, repair_conversations
from .conversation_trie import prefix_trie, rebuilt
from .html_extract import extract_text
from .language_id import identify_languages
from .near_dedup import near_duplicates
from .packing import pack
from .quality_rules import quality_rules
from .scratch import materialize
from .sql import SQL
from .sql_records import RECORDS_SQL
from .substring_dedup import remove_repeats
from .token_counts import sentence_pieces, token_counts
from .topk_search import exact_top_k, integer_vectors
from .url_filter import PAGES_RULES, filter_urls, page_links


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_branch_and_bound_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    rows = materialize(rows, "vectors")
    out = exact_top_k(rows, rows.where("id % 100 = 0"), 10)
    return out.withColumn("rank", F.col("rank").cast("int"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold=(85, 100))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), sentence_pieces(vocabulary("piece_bpe_32k.model")))


def op6_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), mixing.documents_tree(), mixing.DOCUMENTS_WEIGHTS, keep=("doc_id",))
    level = [F.col(f"mix_{x}").alias(x) for x in ("domain", "lang", "source")]
    return mixed.select("doc_id", *level, F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def op7_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = filter_urls(pages.select("page_id", "url"), PAGES_RULES, page_links(pages))
    return judged.select("page_id", *(F.col(f"url_{x}").alias(x) for x in ("host", "path", "rule", "verdict")))


def op8_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op9_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_languages(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op10_suffix_array_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op11_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "sedge-warc")
    write_archive(page_records(_table(spark, sf_dir, "pages")), path)
    return archived_pages(spark, path)


def op12_ternary_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(_table(spark, sf_dir, "conversations")))


def op13_bidirectional_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        op1_branch_and_bound_top_k, op2_substring_dedup, op3_hyperminhash, op4_shortest_pack_first, op5_longest_match_counts,
        op6_hierarchical_mix, op7_redirect_url_filter, op8_line_frequency_rules, op9_ftrl_language_id, op10_suffix_array_text,
        op11_warc_source, op12_ternary_prefix_trie, op13_bidirectional_repair,
    )
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the result; the others are tested by brute force."""
    return SQL | RECORDS_SQL
