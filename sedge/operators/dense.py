"""Exhaustive vector search in tiles.

Vectors are packed into chunks of raw numbers, and chunks are dealt to tiles
of a bounded size.  Each tile is held once by one task, and the blocks of
queries stream past it: a block's scores with the tile are one matrix product,
of which each query keeps its k best.  So the vectors are read and shuffled
once for any number of queries, and what leaves a task is k rows for each
query and tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot
from .lexical import small, top_per_query

#: Bytes of a tile (about), vectors of a chunk and queries of a block at most.
TILE_BYTES, CHUNK, BLOCK = 64 << 20, 1 << 12, 512

_PACKED = "tile int, kind int, nth long, ids binary, scales binary, data binary, width int"
_BEST = "query_id long, id long, score double"


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _pack(size: int, kind: type, spread: int | None) -> Callable:
    """Rows (id, v[, scale]) as packed chunks; a chunk has vectors of one length.

    spread: among so many tiles chunks are dealt; None leaves the tile open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = pid = TaskContext.get().partitionId()
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == width)
                for at in range(0, len(rows), size):
                    some = batch.take(pa.array(rows[at : at + size]))
                    ids = some.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                    scales = some.column("scale").to_numpy(zero_copy_only=False).astype(np.float64)
                    data = _matrix(some.column("v"), int(width), kind)
                    columns = [[None if spread is None else nth % spread], [0 if spread else 1], [(pid << 32) + nth], [ids.tobytes()], [scales.tobytes()], [data.tobytes()], [int(width)]]
                    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["tile", "kind", "nth", "ids", "scales", "data", "width"])
                    nth += 1

    return run


def best_of(scores: np.ndarray, ids: np.ndarray, k: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row, rounded to `places`, ties to the smaller id; NaN is no score."""
    rounded = np.floor(np.nan_to_num(scores, nan=-np.inf) * 10.0**places + 0.5)
    if scores.shape[1] > k:
        bar = np.partition(rounded, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero((rounded >= bar[:, None]) & (rounded > -np.inf))
    else:
        row, column = np.nonzero(rounded > -np.inf)
    order = np.lexsort((ids[column], -rounded[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(scores.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep]


def _search(k: int, places: int, kind: type) -> Callable:
    """Tiles first, then the blocks of queries: the k best of each query in each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() if c in ("tile", "kind", "width") else batch.column(c)[i].as_buffer() for c in ("tile", "kind", "width", "ids", "scales", "data")}
                if row["tile"] != tile:
                    tile, held = row["tile"], {}
                width, ids, scales = row["width"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["scales"], np.float64)
                if row["kind"] == 0:
                    held.setdefault(width, []).append((ids.copy(), scales.copy(), np.frombuffer(row["data"], kind).reshape(-1, width).copy()))
                    continue
                queries = np.frombuffer(row["data"], np.float64).reshape(-1, width) * scales[:, None]
                found = []
                for its, factors, data in held.get(width, ()):
                    scores = (queries @ data.astype(np.float64).T) * factors
                    at, column = best_of(scores, its, k, places)
                    found.append((at, its[column], scores[at, column]))
                if found:
                    at, its, score = (np.concatenate(x) for x in zip(*found))
                    order = np.lexsort((its, -np.floor(score * 10.0**places + 0.5), at))
                    at, its, score = at[order], its[order], score[order]
                    keep = np.arange(len(at)) - np.searchsorted(at, np.arange(len(ids)))[at] < k
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[keep]]), pa.array(its[keep]), pa.array(score[keep])], names=["query_id", "id", "score"])

    return run


def _inverse_norm(v: str):
    """1 / length; a zero vector has none, so that it scores nothing."""
    length = F.sqrt(dot(F.col(v), F.col(v)))
    return F.when(length > 0, 1 / length)


def _top(queries: DataFrame, vectors: DataFrame, k: int, places: int, kind: type, tile: int) -> DataFrame:
    """The k best of queries (id, v, scale) among vectors (id, v, scale): scale * scale * dot."""
    numbers = vectors.agg(F.sum(F.size("v"))).first()[0] or 0
    tiles = max(1, -(-numbers * np.dtype(kind).itemsize // tile))
    chunks = vectors.mapInArrow(_pack(CHUNK, kind, tiles), _PACKED)
    blocks = queries.mapInArrow(_pack(BLOCK, np.float64, None), _PACKED)
    blocks = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    both = chunks.unionByName(blocks).repartition("tile").sortWithinPartitions("tile", "kind", "nth")
    found = both.mapInArrow(_search(k, places, kind), _BEST)
    return top_per_query(found.withColumn("score", F.round("score", places)), k)


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int, places: int = 6, tile: int = TILE_BYTES) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors (id, v) of each query (query_id, qv) by cosine.

    Scores are rounded to `places`, ties go to the smaller id.  Null vectors,
    zero vectors and those of another length than the query's score nothing.
    """
    vectors = vectors.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), "v", _inverse_norm("v").alias("scale")).where("scale is not null")
    asked = queries.where("qv is not null").select(F.col("query_id").cast("long").alias("id"), F.col("qv").alias("v"), _inverse_norm("qv").alias("scale")).where("scale is not null")
    return _typed(_top(asked, vectors, k, places, np.float32 if "float" in dict(vectors.dtypes)["v"] else np.float64, tile), queries)


def int8_top(queries: DataFrame, vectors: DataFrame, k: int, places: int = 6, tile: int = TILE_BYTES) -> DataFrame:
    """(query_id, id, score, rank): the k best of unit queries (query_id, qv) among quantised vectors (id, scale, q)."""
    vectors = vectors.where("id is not null and q is not null").select(F.col("id").cast("long").alias("id"), F.col("q").alias("v"), "scale")
    asked = queries.where("qv is not null").select(F.col("query_id").cast("long").alias("id"), F.col("qv").alias("v"), F.lit(1.0).alias("scale"))
    return _typed(_top(asked, vectors, k, places, np.int8, tile), queries)


def _typed(found: DataFrame, queries: DataFrame) -> DataFrame:
    return found.withColumn("query_id", F.col("query_id").cast(dict(queries.dtypes)["query_id"]))


def cosine_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, id, score) of every pair of a few queries (query_id, qv) and vectors (id, v), where a fusion ranks them all.

    Queries that are counted to be few go to every task; null vectors score nothing.
    """
    held = vectors.where("v is not null")
    return held.crossJoin(small(queries, 1000)).select("query_id", "id", cosine(F.col("v"), F.col("qv")).alias("score"))
