"""Exact top-k inner products from an impact-ordered index, score at a time.

Each task reads its candidates in shards of a bounded number of rows. A shard's index, built once in a pass, has for
every dimension its postings in the order of their component, cut into segments of equal quantised impact. For a query,
a segment's impact is the largest product of the query's component with a component in it, less the least product in
that dimension, so impacts are never negative and a score is a sum of impacts plus a constant.

Segments are processed by falling impact, adding to each candidate's accumulator. What a candidate may still gain is
bounded by the next impact for each dimension in which it has not been met. Once ``k`` candidates, of this shard or of
the task's shards before it, have more than all others can still reach, the rest of the segments cannot change the
members, which proves the stop; all candidates that may still be members are then scored exactly, in integers.

Queries go to all tasks in blocks of a bounded number of bytes, one pass over the candidates for each block; neither
candidates nor queries are copied in a shuffle. A task hands on the best ``k`` of each query, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

#: Rows of a shard and of a block of queries, about, and bytes of their vectors at most.
SHARD_ROWS = 4096
QUERY_ROWS = 16384
SHARD_BYTES = BLOCK_BYTES = 32 << 20
#: Integers up to this are exact as doubles; inner products that may pass it are computed without them.
_EXACT = 1 << 53
LEVELS = 32
#: After these shares of the postings, whether to stop is tested.
ROUNDS = (0.25, 0.5, 0.65, 0.75, 0.85, 1.0)
#: Once no larger share of a shard can still be a member, scoring these exactly costs less than going on.
ENOUGH = 0.15


class Index:
    """Impact-ordered postings of the rows of ``x`` (integers, a row per candidate)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, dims = x.shape
        self.largest = int(np.abs(x).max(initial=0))
        order = np.argsort(x, axis=0, kind="stable")  # postings of each dimension, by rising component
        self.rows = order.T.ravel()
        self.values = np.ascontiguousarray(np.take_along_axis(x, order, axis=0).T)
        self.low, self.high = (self.values[:, 0], self.values[:, -1]) if n else (np.zeros(dims, np.int64),) * 2
        level = (self.values - self.low[:, None]) * LEVELS // np.maximum(self.high - self.low + 1, 1)[:, None]
        new = np.ones((dims, n), bool)
        new[:, 1:] = level[:, 1:] != level[:, :-1]
        self.start = np.flatnonzero(new.ravel())  # segments, in the flat order of postings
        self.end = np.concatenate((self.start[1:], [dims * n])) if self.start.size else self.start
        self.dimension = self.start // max(n, 1)
        flat = self.values.ravel()
        self.least_of, self.most_of = (flat[self.start], flat[self.end - 1]) if self.start.size else (flat, flat)

    def top(self, q: np.ndarray, k: int, own: int | None, bar: int | None = None) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) of a query, ties to smaller ids, without the id ``own``; with a ``bar``, of those
        that score no less than it."""
        n, dims = self.x.shape
        allowed = np.ones(n, bool) if own is None else self.ids != own
        possible = allowed
        if dims * self.largest * int(np.abs(q).max(initial=0)) >= _EXACT:
            rows = np.flatnonzero(allowed)
            scores = [sum(map(mul, v, q.tolist())) for v in self.x[rows].tolist()]
            best = sorted(zip(scores, self.ids[rows].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]
            if any(abs(x) > 9_223_372_036_854_775_807 for x, _ in best):
                raise OverflowError("an inner product among the best exceeds 64 bits")
            return [x for x in best if bar is None or x[0] >= bar]
        if allowed.sum() > 4 * k and q.any():
            base = np.minimum(q * self.low, q * self.high)
            float_q = q.astype(np.float64)
            gain = (self.values * float_q[:, None] - base[:, None]).ravel()
            w = q[self.dimension]
            impact = np.where(w > 0, w * self.most_of, w * self.least_of) - base[self.dimension]
            by_impact = np.argsort(-impact, kind="stable")
            most = np.maximum(q * self.low, q * self.high) - base
            upto = np.cumsum((self.end - self.start)[by_impact])
            gained, met = np.zeros(n), np.zeros(n, np.int64)
            done = 0
            for share in ROUNDS:
                stop = int(np.searchsorted(upto, share * upto[-1], "left")) + 1
                segments = np.sort(by_impact[done:stop])
                done = stop
                if segments.size:
                    # Segments next to each other are one stretch of postings.
                    a, b = self.start[segments], self.end[segments]
                    apart = np.flatnonzero(a[1:] != b[:-1])
                    stretches = list(zip(a[np.concatenate(([0], apart + 1))].tolist(), b[np.concatenate((apart, [-1]))].tolist(), strict=True))
                    rows = np.concatenate([self.rows[x:y] for x, y in stretches])
                    gained += np.bincount(rows, np.concatenate([gain[x:y] for x, y in stretches]), n)
                    met += np.bincount(rows, minlength=n)
                ahead = impact[by_impact[stop]] if stop < by_impact.size else 0
                # No impact that is left exceeds the next one, nor the largest of its dimension.
                begun = most > ahead
                reach = gained + most[~begun].sum() + (int(begun.sum()) - met) * ahead
                sure = np.partition(gained[allowed], -k)[-k]
                if bar is not None:
                    sure = max(sure, bar - base.sum())
                possible = allowed & (reach >= sure)
                if possible.sum() <= max(4 * k, n * ENOUGH):  # the others cannot reach the k-th: proof
                    break
        rows = np.flatnonzero(possible)
        scores = self.x[rows] @ q
        if bar is not None:
            rows, scores = rows[scores >= bar], scores[scores >= bar]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return [(int(scores[i]), int(self.ids[rows[i]])) for i in best]


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``: components as ``floor(scale * x)``, x as double, of vectors that take part.

    A vector that is null or has a null or non-finite component takes no part; nor has a null id. A component that does
    not fit into 62 bits raises an error, as its products would not fit into a score.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = lambda e: F.when(F.abs(e * scale) < 2.0**62, F.floor(e * scale).cast("long")).otherwise(F.raise_error(F.lit("a component exceeds 62 bits")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select("vec_id", F.transform(x, whole).alias("v"))


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones count as having zeros at their end."""
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _shards(batches: Iterator[pa.RecordBatch], rows: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a task's candidates, ``rows`` at a time."""
    ids: list[int] = []
    lists: list[list[int]] = []
    for b in batches:
        ids += b.column("vec_id").to_pylist()
        lists += b.column("v").to_pylist()
        while len(ids) >= rows:
            yield np.array(ids[:rows], np.int64), _matrix(lists[:rows], width)
            ids, lists = ids[rows:], lists[rows:]
    if ids:
        yield np.array(ids, np.int64), _matrix(lists, width)


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates of largest integer inner product for each query.

    Both have ``vec_id, v`` as :func:`scaled` gives them. A query's own id is no candidate. Ranks start at 1; ties go
    to the smaller id; fewer candidates than ``k`` give fewer rows. Rows that repeat an id count as rows of their own;
    queries of one id have one list of ``k``, the best of all their vectors' scores. Empty tables give no rows. A score
    among the best that does not fit into 64 bits raises an error.
    """
    spark = candidates.sparkSession
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    held = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(asked.width or 0, held.width or 0, 1)
    rows = max(1, min(shard_rows, SHARD_BYTES // (8 * width)))
    n_blocks = max(1, -(-asked.n // max(1, min(query_rows, BLOCK_BYTES // (8 * width)))))
    # Stored, as repeated rows are dealt over blocks by their place.
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks))
    stored = spool(queries.select("vec_id", "v", dealt.alias("block")))
    spread = candidates.select("vec_id", "v").repartition(max(1, -(-held.n // rows)))
    found = None
    for block in range(n_blocks):
        part = stored.where(F.col("block") == block).select("vec_id", "v").toArrow()  # of about query_rows
        sent = spark.sparkContext.broadcast((part.column("vec_id").to_numpy().astype(np.int64), _matrix(part.column("v").to_pylist(), width)))

        def meet(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            best: list[list[tuple[int, int]]] = [[] for _ in ids]
            for held_ids, x in _shards(batches, rows, width):
                index = Index(held_ids, x)
                for i, own in enumerate(ids.tolist()):
                    bar = best[i][-1][0] if len(best[i]) == k else None
                    if more := index.top(vectors[i], k, own, bar):
                        best[i] = sorted(best[i] + more, key=lambda s: (-s[0], s[1]))[:k]
            out = [(own, vec_id, score) for own, top in zip(ids.tolist(), best, strict=True) for score, vec_id in top]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        met = spread.mapInArrow(meet, "query_id long, vec_id long, score long")
        found = met if found is None else found.unionByName(met)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Rows whose ``vec_id`` is divisible by 50 searched against all rows; equal rows are one query."""
    every = scaled(vectors)
    return search(every.where("vec_id % 50 = 0").dropDuplicates(["vec_id", "v"]), every, k)
