"""Query variants from synonyms: (query_id, pos, variant)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import synonym_variants


def expand(queries: DataFrame, synonyms: dict[str, list[str]], limit: int = 3, first_only: bool = False, text_col: str = "text") -> DataFrame:
    """The query itself, then one variant for each synonym of a key that it contains.

    The server replaces every occurrence of the key, the client (first_only)
    the first.  `synonyms` may have very many keys, tried in their order: all
    are looked for in one pass over a query.
    """
    return queries.select("query_id", F.posexplode(synonym_variants(F.col(text_col), synonyms, first_only, limit)).alias("pos", "variant"))


def joined_expansion(queries: DataFrame, synonyms: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """The variants of each query in one string."""
    return queries.select("query_id", F.array_join(synonym_variants(F.col(text_col), synonyms, False, 3), " ").alias("expanded"))
