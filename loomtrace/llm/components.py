"""Connected components of a stored edge list, by alternating large-star and small-star steps.

Edges stay in tables: nothing about nodes or components reaches the driver but two sums that tell when to stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: From this many edges on, least neighbours are stored before they are joined: a join of two plain shuffles can be split
#: where a node has very many neighbours, one with an aggregate on it cannot. Results are the same.
STORED_FROM = 5_000_000


def _least(edges: DataFrame, stored: bool) -> DataFrame:
    """The least neighbour of each ``a``."""
    out = edges.groupBy("a").agg(F.min("b").alias("m"))
    return cut(out) if stored else out


def _large_star(edges: DataFrame, stored: bool) -> DataFrame:
    """Larger neighbours of each node are linked to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, stored).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, stored: bool) -> DataFrame:
    """Smaller neighbours of each node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = _least(down, stored)
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a``, ``b`` of one orderable type, neither null).

    ``component`` is the least node reachable. Loops and repeated edges are allowed; an edge list without rows gives
    no rows.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        # Sums of two independent 64-bit hashes tell two edge lists apart.
        now = edges.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64("a", "b", F.lit(salt)).cast("decimal(38,0)")) for salt in (1, 2)]).first()
        if now == state or not now[0]:
            break
        state = now
        stored = now[0] >= STORED_FROM
        edges = cut(_small_star(_large_star(edges, stored), stored))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
