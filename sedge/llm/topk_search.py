"""Exact top-k inner-product search by columnar branch and bound.

Candidates are dealt into tiles of a bounded number of bytes, each one row,
and queries into blocks.  A task holds a tile by dimension and lets up to UNIT
blocks stream past it, so a tile is sent and turned once for so many blocks.
Scores accumulate one block of dimensions at a time, the dimensions with most
mass first; after each a candidate's score can grow at most by the product of
the two remaining norms (Cauchy-Schwarz), and candidates whose bound is below
the query's bar are compacted away.

The first tile is searched ahead of the others.  A query's k-th best score
there is its bar in all other tiles, each of which raises it by its own best.
So most tiles return few rows of a query, and a ranking merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, text_batches

#: Components of a tile and of a query block, on average (8 bytes each).
TILE, BLOCK = 1 << 20, 1 << 17
#: Blocks that stream past one copy of a tile, at most.
UNIT = 64
#: Dimensions added between two compactions.
DIMS = 16
#: Largest sum that doubles add up without rounding.
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, vec): floor(scale * component) as long, of the usable rows.

    Rows with a null id, a null vector or a null, NaN or infinite component
    take no part.  Rows that share an id are one vector, the least of them;
    where a count of the ids finds none shared, no vector is shuffled for it.
    """
    v = F.transform(vec_col, lambda x: x.cast("double"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & usable)
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = rows.select("id", whole.alias("vec"))
    ids = vectors.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    if ids.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def _members(row: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors (a row each) and bars (NaN in a tile) of a tile or block."""
    held = row.values
    flat = held.field(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    bars = held.field(2).to_numpy(zero_copy_only=False).astype(np.float64)
    return held.field(0).to_numpy(zero_copy_only=False), flat.reshape(len(held), -1), bars


class _Tile:
    """Candidates of one length by dimension, those with most mass first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.most = ids, float(np.abs(vectors).max()) if vectors.size else 0.0
        self.order = np.argsort(-(vectors.astype(float) ** 2).sum(axis=0), kind="stable")
        self.column = np.ascontiguousarray(vectors[:, self.order].T.astype(float))
        self.whole = vectors  # for sums that doubles would round
        self.cuts = list(range(0, len(self.column), DIMS))
        self.rest = self._rest(self.column**2)

    def _rest(self, squares: np.ndarray) -> list[np.ndarray]:
        """Norms of what lies behind each block of dimensions."""
        tail = np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])
        return [tail[b] if b < len(tail) else np.zeros(squares.shape[1]) for b in [*self.cuts[1:], len(tail)]]

    def search(self, q_ids: np.ndarray, q: np.ndarray, bars: np.ndarray, k: int) -> list[np.ndarray]:
        """query id, candidate id and score of each query's k best here that reach its bar."""
        rounded = not self.cuts or self.most * float(np.abs(q).max()) * len(self.column) >= _EXACT
        one_of = self._plain if rounded else self._bounded(q, bars, k)
        found: tuple[list, list, list] = ([], [], [])
        for at in range(len(q)):
            alive, score = one_of(at, q, q_ids[at])
            best = np.lexsort((self.ids[alive], -score))[:k]
            found[0].append(np.full(len(best), q_ids[at]))
            found[1].append(self.ids[alive[best]])
            found[2].append(score[best])
        return [np.concatenate(x).astype(np.int64) for x in found]

    def _plain(self, at: int, q: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        alive = np.flatnonzero(self.ids != own)
        return alive, self.whole[alive] @ q[at]

    def _bounded(self, q: np.ndarray, bars: np.ndarray, k: int):
        query = q[:, self.order].astype(float)
        q_rest = self._rest(query.T**2)
        first = self.column[:DIMS]
        some: dict[int, np.ndarray] = {}

        def one_of(at: int, _: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
            if at % 64 == 0:  # the first dimensions of many queries in one product
                some["begun"] = query[at : at + 64, :DIMS] @ first
            one, least = query[at], bars[at]
            alive = np.flatnonzero(self.ids != own)
            score = some["begun"][at % 64][alive]
            for b, cut in enumerate(self.cuts):
                if b:
                    score = score + one[cut : cut + DIMS] @ self.column[cut : cut + DIMS, alive]
                most = (score + self.rest[b][alive] * q_rest[b][at]) * (1 + 1e-12) + 1.0
                if b == 0 and len(alive) > k:  # exact scores of the most promising raise the bar
                    seed = alive[np.argpartition(-most, k)[: 2 * k]] if len(alive) > 2 * k else alive
                    exact = one @ self.column[:, seed]
                    least = max(least, np.partition(exact, len(exact) - k)[len(exact) - k])
                keep = most >= least
                alive, score = alive[keep], score[keep]
            score = score.astype(np.int64)
            return alive[score >= least], score[score >= least]

        return one_of


def _search(k: int):
    """Rows (dim, tile, copy, kind, members): a tile first, then the blocks that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                here = tuple(batch.column(c)[i].as_py() for c in ("dim", "tile", "copy"))
                members = batch.column("members")[i]
                if batch.column("kind")[i].as_py() == 0:
                    key, tile = here, _Tile(*_members(members)[:2])
                elif key == here:
                    found = tile.search(*_members(members), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query.

    Both inputs are (id, vec array<long>) with one row for an id and no nulls
    (`integer_vectors` folds rows that share an id into the least of them).
    A query is not a candidate for itself; ties go to the smaller id; only
    vectors of the query's length are candidates; a query with fewer than k
    candidates returns all, one without (or with an empty table) returns none.
    Other columns don't matter, whatever their names.
    """
    text_batches(candidates.sparkSession)
    sized = lambda df: int(df.agg(F.coalesce(F.sum(F.greatest(F.size("vec"), F.lit(1))), F.lit(0))).first()[0])
    n_tiles, n_blocks = max(1, -(-sized(candidates) // TILE)), max(1, -(-sized(queries) // BLOCK))
    copies = -(-n_blocks // UNIT)
    lot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    dim = F.size("vec").alias("dim")
    members = lambda bar: F.collect_list(F.struct("id", "vec", bar.cast("double").alias("bar"))).alias("members")
    tiles = candidates.select("id", "vec", dim, lot(n_tiles).alias("tile"))
    tiles = materialize(tiles.groupBy("dim", "tile").agg(members(F.lit(None))), "tiles")

    def met(asked: DataFrame, first: int, last: int) -> DataFrame:
        """The best of each query in each tile from `first` to `last`."""
        blocks = asked.groupBy("dim", "block").agg(members(F.col("bar")))
        blocks = blocks.select("dim", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("tile"), F.pmod("block", F.lit(copies)).alias("copy"), F.lit(1).alias("kind"), "members")
        held = tiles.where(F.col("tile").between(first, last))
        held = held.select("dim", "tile", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), "members")
        both = held.unionByName(blocks).repartition("dim", "tile", "copy").sortWithinPartitions("dim", "tile", "copy", "kind")
        return both.mapInArrow(_search(k), "query_id long, vec_id long, score long")

    asked = queries.select("id", "vec", dim, lot(n_blocks).alias("block"), F.lit(float("-inf")).alias("bar"))
    found = materialize(_top(met(asked, 0, 0), k).drop("rank"), "first")
    if n_tiles > 1:
        bars = found.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
        bars = bars.where(F.col("n") == k).select(F.col("query_id").alias("id"), F.when(F.abs("score") < _EXACT, F.col("score").cast("double")).alias("known"))
        asked = asked.join(bars, "id", "left").withColumn("bar", F.coalesce("known", "bar")).drop("known")
        found = found.unionByName(met(asked, 1, n_tiles - 1))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
