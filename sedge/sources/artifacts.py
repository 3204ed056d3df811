"""The index as tables, and the legacy binary vector file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.profiles import Profile
from ..functions.vectors import quantize
from ..operators import lexical

MAGIC = b"SNV1"


def write_index(chunks: DataFrame, profile: Profile, path: str, vectors: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> None:
    """Write chunks, postings, lengths, stats (and vectors) below `path`.

    A manifest of one row is written last.  Tokens are computed once; postings are ordered by term, so that a scan
    for a few terms skips row groups.
    """
    counted = lexical.counted(lexical.occurrences(chunks, profile, id_col, text_col))
    counted.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    lexical.lengths(chunks.sparkSession.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/lengths")
    stats = lexical.statistics(chunks.sparkSession.read.parquet(f"{path}/lengths"))
    stats.withColumns({"k1": F.lit(lexical.K1), "b": F.lit(lexical.B)}).write.mode("overwrite").parquet(f"{path}/stats")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    dim = F.lit(0)
    if vectors is not None:
        quantize(vectors, "v").select("id", "scale", "q").write.mode("overwrite").parquet(f"{path}/vectors")
        dim = F.coalesce(F.max(F.size("q")), F.lit(0))
    held = chunks.sparkSession.read.parquet(f"{path}/{'stats' if vectors is None else 'vectors'}")
    manifest = held.agg(dim.cast("int").alias("dim"), F.lit(60).alias("rrf_k"), F.lit("int8").alias("quantisation"), F.current_timestamp().alias("built_at"))
    manifest.withColumn("has_vectors", F.lit(vectors is not None)).write.mode("overwrite").parquet(f"{path}/manifest")  # last: an index with a manifest is whole


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("chunks", "postings", "lengths", "stats")}
    manifest = spark.read.parquet(f"{path}/manifest").first()
    vectors = None
    if manifest.has_vectors:
        value = F.transform("q", lambda x: x.cast("double") * F.col("scale"))
        vectors = spark.read.parquet(f"{path}/vectors").select("id", value.alias("v"))
    return tables | {"postings": tables["postings"].where("term <> ''"), "vectors": vectors}


def _encode(rows: pd.DataFrame) -> bytes:
    q = np.array(rows["q"].tolist(), dtype=np.int8)
    head = MAGIC + struct.pack("<II", q.shape[1] if q.size else 0, len(rows))
    return head + rows["scale"].to_numpy(dtype="<f4").tobytes() + q.tobytes()


def encode_shards(vectors: DataFrame, rows_a_shard: int = 4096) -> DataFrame:
    """(shard, ids, content): legacy vector files of a bounded number of rows each.

    `vectors` has id, scale and q.
    """
    shards = F.greatest(F.lit(1), F.ceil(F.lit(vectors.count() / rows_a_shard))).cast("long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "ids": [pdf["id"].tolist()], "content": [_encode(pdf)]})

    dealt = vectors.select("id", "scale", "q", F.pmod(F.xxhash64("id"), shards).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(run, "shard long, ids array<long>, content binary")


def decode_shards(files: DataFrame) -> DataFrame:
    """(id, scale, q) of legacy vector files; a wrong magic or length is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, content in zip(pdf["ids"], pdf["content"]):
                dim, count = struct.unpack("<II", content[4:12])
                if content[:4] != MAGIC or count != len(ids) or len(content) != 12 + count * (4 + dim):
                    raise ValueError("not a vector file of these rows")
                scale = np.frombuffer(content, "<f4", count, 12)
                q = np.frombuffer(content, np.int8, count * dim, 12 + 4 * count).reshape(count, dim)
                yield pd.DataFrame({"id": list(ids), "scale": scale, "q": list(q)})

    return files.select("ids", "content").mapInPandas(run, "id long, scale float, q array<tinyint>")


def read_json_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The JSON artifacts of a static index as tables.

    docs and chunks keep their ordinals; bm25 becomes postings (term, id, tf),
    lengths (id, dl) and stats; synonyms (ord, key, alternatives).
    """
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}.json", multiLine=True)
    bm25 = read("bm25", "k1 double, b double, avgdl double, len array<bigint>, postings map<string, array<array<bigint>>>")
    terms = bm25.select(F.explode("postings").alias("term", "list")).select("term", F.explode("list").alias("p"))
    text = spark.read.text(f"{path}/synonyms.json", wholetext=True)
    pairs = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string, array<string>>"))).alias("ord", "e"))
    return {
        "docs": read("docs", "id string, number string, title string, status string, pages int, file string").withColumn("d", F.monotonically_increasing_id()),
        "chunks": read("chunks", "i int, d int, p string, pg int, t string, ty string"),
        "postings": terms.select("term", F.col("p")[0].alias("id"), F.col("p")[1].alias("tf")),
        "lengths": bm25.select(F.posexplode("len").alias("id", "dl")),
        "stats": bm25.select(F.size("len").alias("n"), "avgdl", "k1", "b"),
        "synonyms": pairs.select("ord", F.col("e.key").alias("key"), F.col("e.value").alias("alternatives")),
    }
