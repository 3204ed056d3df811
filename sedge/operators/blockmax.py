"""Compressed posting lists with block maxima, and the search that skips by them.

Rows of text are dealt to shards of a bounded number.  A shard's postings of a
term are one list: blocks of 128 entries, ids as differences, each number in
the fewest of 1, 2, 4 or 8 bytes that hold the block's, and for each block the
range of its ids and the greatest weight of an entry.  A query cuts a shard's
ids into intervals in which every term has at most one block; the sum of the
blocks' maxima (of a rare term its entries) bounds what an interval can score.  Intervals are taken from
the best bound on, and the search ends where the bound is under the k-th best
score: the blocks of all further intervals are never decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .lexical import B, K1, small, top_per_query

#: Entries of a block, rows of text of a shard (about), queries that meet a shard at once.
BLOCK, SHARD, QUERIES = 128, 1 << 16, 1000
_LIST = "shard int, term string, n long, first binary, last binary, most binary, widths binary, starts binary, data binary"
_SIZES = (1, 2, 4, 8)


def _width(most: int) -> int:
    return next(i for i, size in enumerate(_SIZES) if most >> (8 * size) == 0)


def weight(tf: np.ndarray, dl: np.ndarray, avgdl: float, k1: float = K1, b: float = B) -> np.ndarray:
    """What an entry adds to a score, apart from its term's idf."""
    dl = np.where(dl == 0, avgdl, dl)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


class PostingList:
    """A term's entries (id ascending, tf, dl) in a shard."""

    def __init__(self, first: bytes, last: bytes, most: bytes, widths: bytes, starts: bytes, data: bytes, n: int):
        self.first, self.last = np.frombuffer(first, np.int64), np.frombuffer(last, np.int64)
        self.most, self.starts = np.frombuffer(most, np.float64), np.frombuffer(starts, np.int64)
        self.widths, self.data, self.n = np.frombuffer(widths, np.uint8).reshape(-1, 3), data, n
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @classmethod
    def encode(cls, ids: np.ndarray, tf: np.ndarray, dl: np.ndarray, avgdl: float) -> dict:
        first, last, most, widths, starts, data = [], [], [], [], [], bytearray()
        weights = weight(tf, dl, avgdl)
        for at in range(0, len(ids), BLOCK):
            part = slice(at, at + BLOCK)
            columns = (np.diff(ids[part], prepend=ids[at]), tf[part], dl[part])
            first.append(ids[at])
            last.append(ids[part][-1])
            most.append(weights[part].max())
            starts.append(len(data))
            for numbers in columns:
                w = _width(int(numbers.max()))
                widths.append(w)
                data += numbers.astype(f"<u{_SIZES[w]}").tobytes()
        raw = lambda x, kind: np.array(x, kind).tobytes()
        return {"n": len(ids), "first": raw(first, np.int64), "last": raw(last, np.int64), "most": raw(most, np.float64), "widths": raw(widths, np.uint8), "starts": raw(starts, np.int64), "data": bytes(data)}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, tf, dl) of a block."""
        if i not in self.decoded:
            size, at, out = min(BLOCK, self.n - i * BLOCK), int(self.starts[i]), []
            for w in self.widths[i].tolist():
                out.append(np.frombuffer(self.data, f"<u{_SIZES[w]}", size, at).astype(np.int64))
                at += size * _SIZES[w]
            self.decoded[i] = np.cumsum(out[0]) + self.first[i], out[1], out[2]
        return self.decoded[i]


def best(lists: dict[str, PostingList], terms: list[tuple[str, float]], k: int, avgdl: float, places: int = 6) -> list[tuple[int, float]]:
    """The k best (id, score) of a shard for a query's terms (term, idf), scores rounded, ties to the smaller id."""
    held = [(lists[t], idf) for t, idf in terms if t in lists]
    if not held:
        return []
    edges = np.unique(np.concatenate([np.concatenate([p.first, p.last + 1]) for p, _ in held]))
    at = []  # the block of each list in each interval [edge, next edge), or -1
    bound = np.zeros(len(edges))
    blocks = sum(len(p.first) for p, _ in held)
    for p, idf in held:
        i = np.searchsorted(p.first, edges, side="right") - 1
        i[(i >= 0) & (p.last[np.maximum(i, 0)] < edges)] = -1
        at.append(i)
        if 8 * len(p.first) <= blocks:  # of a rare term, whose blocks reach far, the entries themselves say where it counts
            most = np.zeros(len(edges))
            for own, tf, dl in map(p.block, range(len(p.first))):
                np.maximum.at(most, np.searchsorted(edges, own, side="right") - 1, weight(tf, dl, avgdl))
            bound += idf * most
        else:
            bound += np.where(i >= 0, idf * p.most[np.maximum(i, 0)], 0.0)
    slack = 10.0**-places  # by what rounding may lift a score
    found: list[tuple[float, int]] = []
    bar = -np.inf
    for interval in np.argsort(-bound, kind="stable").tolist():
        if bound[interval] <= 0 or bound[interval] + slack < bar:
            break
        low = edges[interval]
        high = edges[interval + 1] if interval + 1 < len(edges) else np.iinfo(np.int64).max
        ids, scores = [], []
        for (p, idf), i in zip(held, at):
            if i[interval] >= 0:
                own, tf, dl = p.block(int(i[interval]))
                part = slice(np.searchsorted(own, low), np.searchsorted(own, high))
                ids.append(own[part])
                scores.append(idf * weight(tf[part], dl[part], avgdl))
        own, place = np.unique(np.concatenate(ids), return_inverse=True)
        total = np.floor(np.bincount(place, np.concatenate(scores)) * 10.0**places + 0.5) / 10.0**places
        order = np.lexsort((own, -total))[:k]
        found = sorted([*found, *zip((-total[order]).tolist(), own[order].tolist())])[:k]
        if len(found) == k:
            bar = -found[-1][0]
    return [(i, -score) for score, i in found]


def _encode(avgdl: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard, term, entries in zip(batch.column("shard").to_pylist(), batch.column("term").to_pylist(), batch.column("entries")):
                ids, tf, dl = (entries.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "tf", "dl"))
                rows.append({"shard": shard, "term": term} | PostingList.encode(ids, tf, dl, avgdl))
            names = [c.split()[0] for c in _LIST.split(", ")]
            kinds = (pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names=names)

    return run


def shard_lists(postings: DataFrame, lengths: DataFrame, stats: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int, int, float]:
    """(lists, shards, n, avgdl): the compressed lists of postings (term, id, tf) with lengths (id, dl).

    A list has at most the rows of its shard, of which there are about
    `shard`, so a term of all texts is many lists.
    """
    n, avgdl = stats.select("n", "avgdl").first()
    shards = max(1, -(-n // shard))
    rows = postings.join(lengths, "id").select(F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(shards)).cast("int").alias("shard"), "term", F.col("id").cast("long").alias("id"), "tf", "dl")
    entries = rows.groupBy("shard", "term").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("entries"))
    return entries.mapInArrow(_encode(avgdl or 1.0), _LIST), shards, n, avgdl or 1.0


def _search(k: int, avgdl: float, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lists = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, lists = row["shard"], {}
                if row["asked"] is None:
                    lists[row["term"]] = PostingList(*(row[c] for c in ("first", "last", "most", "widths", "starts", "data", "n")))
                    continue
                asked: dict = {}
                for q in row["asked"]:
                    asked.setdefault(q["query_id"], []).append((q["term"], q["idf"]))
                found = [(q, i, score) for q, terms in asked.items() for i, score in best(lists, terms, k, avgdl, places)]
                columns = list(zip(*found)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    return run


def top(terms: DataFrame, lists: DataFrame, shards: int, n: int, avgdl: float, k: int, places: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best rows of each query (query_id, term) by BM25.

    Only lists of the queries' terms are read; each shard's are held by one
    task once, and blocks of queries stream past them.
    """
    asked = terms.select(F.col("query_id").cast("long").alias("query_id"), "term").distinct()
    held = staged(lists.join(small(asked.select("term").distinct()), "term", "left_semi"), "held")
    df = held.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.select("query_id").distinct().count() // QUERIES))))
    blocks = asked.join(df, "term").groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("query_id", "term", idf.alias("idf")))).alias("asked"))
    blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "asked")
    none = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _LIST.split(", ")[1:])]
    kind = dict(blocks.dtypes)["asked"]
    both = held.select(*(f.split()[0] for f in _LIST.split(", ")), F.lit(None).cast(kind).alias("asked")).unionByName(blocks.select("shard", *none, "asked"))
    both = both.repartition("shard").sortWithinPartitions("shard", F.col("asked").isNotNull())
    found = both.mapInArrow(_search(k, avgdl, places), "query_id long, id long, score double")
    out = top_per_query(found, k)
    return out.withColumn("query_id", F.col("query_id").cast(dict(terms.dtypes)["query_id"]))
