"""Connected components of a distributed edge list, by alternating stars.

The large-star and small-star steps of Kiveris et al. ("Connected Components
in MapReduce and Beyond", 2014) as grouped minima and joins.  Neither step
gathers a neighbourhood: a hub with a third of all edges only contributes
partial minima, and its edges meet the minimum in a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


#: Nodes up to this number (16 bytes each) may be broadcast with their least neighbour.
MAX_BROADCAST_NODES = 1_000_000


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of `edges` (u, v); component: least node.

    `u` and `v` are of one orderable type; null ends and loops link nothing,
    repeated edges count once.  Nodes that are in no edge are not returned.
    The least neighbours go to the edges where the edges are counted to have
    few ends, which keeps a hub's edges where they are; else they meet in a join.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = materialize(edges.distinct(), "edges")
    last = _signature(edges)
    few = 2 * last[0] <= MAX_BROADCAST_NODES

    def with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
        return pairs.join(F.broadcast(least) if few else least, "u")

    for _ in range(max_rounds if last[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: greater neighbours point to the least of u
        large = with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and all it points to point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, old = materialize(small, "stars"), edges
        discard(old)
        now = _signature(edges)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
