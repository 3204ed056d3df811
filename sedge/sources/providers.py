"""External services as pluggable batch functions.

No model, OCR or PDF library belongs to the engine: a provider is an object
with a batch method, and these wrappers run it on Arrow batches.  Equal texts
are embedded once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.answers import repaired_output, strict_grounded


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str | None]: ...


class PageReader(Protocol):
    """Reads the pages of a file's bytes; OCR is another reader of the same kind."""

    def pages(self, content: bytes) -> list[str]: ...


def embed(texts: DataFrame, provider: Embedder, text_col: str = "text", batch: int = 64, limit: int = 8000) -> DataFrame:
    """`texts` with their embedding (null for a null text), equal texts embedded once."""
    key = F.lower(F.trim(F.substring(text_col, 1, limit)))
    once = texts.select(key.alias("embed_key")).where("embed_key is not null").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                vectors = provider.embed(part["embed_key"].tolist())
                if any(len(v) != provider.dim for v in vectors):
                    raise ValueError(f"embeddings are not of length {provider.dim}")
                yield pd.DataFrame({"embed_key": part["embed_key"], "embedding": vectors})

    vectors = once.mapInPandas(run, "embed_key string, embedding array<float>")
    return texts.withColumn("embed_key", key).join(vectors, "embed_key", "left").drop("embed_key")


def generate(prompts: DataFrame, provider: Generator, batch: int = 16) -> DataFrame:
    """(query_id, output) of prompts (query_id, prompt); a failed one is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"query_id": part["query_id"], "output": provider.generate(part["prompt"].tolist())})

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, output string")


def prompts(queries: DataFrame, contexts: DataFrame, template: str) -> DataFrame:
    """(query_id, prompt): `template` with {query} and {context} filled in."""
    filled = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.col("context")), F.lit("{query}"), F.col("text"))
    return queries.join(contexts, "query_id").select("query_id", filled.alias("prompt"))


def file_pages(files: DataFrame, reader: PageReader) -> DataFrame:
    """(path, page, text) of the files of a binaryFile scan."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                pages = reader.pages(content)
                yield pd.DataFrame({"path": [path] * len(pages), "page": range(1, len(pages) + 1), "text": pages})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


#: What a model is asked, with its temperature and its most tokens.
FAST = "Выдержки из нормативов:\n{context}\n\nЗапрос: {query}\n\nОтветь в 2-4 предложениях только по выдержкам. Верни один объект JSON: answer, normative_basis, paragraph, page, quote (дословно), status."
DEEP = "Выдержки из разных нормативов:\n{context}\n\nЗапрос: {query}\n\nСравни документы, отметь противоречия и приоритет действующих, ответь в 4-7 предложениях только по выдержкам. Верни один объект JSON: answer, normative_basis, paragraph, page, quote (дословно), status."
MODES = {"fast": (FAST, 0.1, 1000), "deep": (DEEP, 0.15, 1600)}
STRICTER = "\n\nВажно: quote должна быть дословным фрагментом выдержек."


def generate_grounded(queries: DataFrame, contexts: DataFrame, provider: Generator, mode: str = "fast") -> DataFrame:
    """(query_id, output, quote, is_grounded, retried) of queries (query_id, text).

    An answer whose quote no context holds is asked for once more with a
    stricter prompt; the second answer counts, grounded or not.
    """
    template = MODES[mode][0]

    def judged(asked: DataFrame) -> DataFrame:
        said = generate(asked, provider).withColumnRenamed("output", "text")
        said = repaired_output(said).withColumn("quote", F.get_json_object("json", "$.quote"))
        grounded = strict_grounded(F.col("quote"), F.col("context"), F.lit(False))
        return said.join(contexts, "query_id").select("query_id", F.col("text").alias("output"), "quote", grounded.alias("is_grounded"))

    asked = prompts(queries, contexts, template)
    first = judged(asked)
    missed = first.where("NOT is_grounded").select("query_id")
    again = judged(asked.join(missed, "query_id", "left_semi").withColumn("prompt", F.concat("prompt", F.lit(STRICTER))))
    again = again.select("query_id", *(F.col(c).alias(f"again_{c}") for c in ("output", "quote", "is_grounded")))
    both = first.join(again, "query_id", "left").withColumn("retried", F.col("again_is_grounded").isNotNull())
    later = lambda c: F.when(F.col("retried"), F.col(f"again_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("query_id", later("output"), later("quote"), later("is_grounded"), "retried")
