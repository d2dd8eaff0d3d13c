"""Exact top-k search by inner product, with a KD-tree for each shard.

Vectors are whole numbers, floor(1024 x).  A shard's tree splits at medians and
keeps a tight box around every node; the box's bound is the largest inner
product that a point in it could have with the query.  A query goes through the
tree best bound first and stops once no box can beat its k-th score so far.  That
k-th score starts from a bounded sample, is carried on from shard to shard of a
task, and with equal scores the smaller id wins, so whole boxes of equal vectors
are left out too.

Queries are worked through in blocks of bounded size; only a block's vectors are
broadcast.  Each task gives at most k rows a query.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 1024
SHARD, LEAF = 8192, 256
#: Queries of a block (broadcast), and rows of the sample that k-th scores start from.
QUERIES, SAMPLE = 8192, 4096


def exact(limit: float, width: int) -> type:
    """The number type in which inner products of such whole numbers are exact."""
    return np.float64 if limit < 2**26 and limit * limit * max(1, width) < 2**53 else object


class Tree:
    """KD-tree over the rows of ``points``, ordered by ids within equal points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.lo, self.hi, self.least, self.kids, self.rows = [], [], [], [], []
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self._grow(np.arange(len(ids)), leaf)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        here, node = self.points[rows], len(self.kids)
        lo, hi = here.min(0), here.max(0)
        for to, x in ((self.lo, lo), (self.hi, hi), (self.least, self.ids[rows].min()), (self.kids, None), (self.rows, None)):
            to.append(x)
        if len(rows) <= leaf:
            self.rows[node] = rows
        else:
            axis = int(np.argmax(hi - lo))
            split = np.argsort(here[:, axis], kind="stable")  # the median by place: halves even if values are equal
            half = len(rows) // 2
            self.kids[node] = (self._grow(np.sort(rows[split[:half]]), leaf), self._grow(np.sort(rows[split[half:]]), leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, best: Best) -> None:
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < best.kth:
                return
            if -top == best.kth and self.least[node] > best.last:
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= best.kth:
                        heapq.heappush(heap, (-bound[kid], kid))
            else:
                rows = self.rows[node]
                scores = self.points[rows] @ query
                take = (scores >= best.kth) & (self.ids[rows] != own)
                if take.any():
                    best.add(scores[take], self.ids[rows[take]])


class Best:
    """The k best rows so far, as (-score, id) in order; ``kth`` is what a newcomer must reach."""

    def __init__(self, k: int, kth: float = -np.inf):
        self.k, self.kth, self.last = k, kth, np.iinfo(np.int64).max
        self.rows: list[tuple] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.rows = heapq.nsmallest(self.k, [*self.rows, *zip((-scores).tolist(), ids.tolist(), strict=True)])
        if len(self.rows) == self.k and -self.rows[-1][0] >= self.kth:
            self.kth, self.last = -self.rows[-1][0], self.rows[-1][1]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and a vector of finite components, as (id, v)."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def whole(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and whole-number rows of vectors, by their width."""
    by = defaultdict(list)
    for i, v in enumerate(vectors):
        by[len(v)].append(i)
    return {w: (np.array(at), np.floor(np.array([vectors[i] for i in at], float).reshape(len(at), w) * SCALE)) for w, at in by.items()}


def topk(queries: DataFrame, base: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k best rows of ``base``.

    Rows without an id, and vectors that are null or hold null or non-finite
    components, take no part.  A row of the query's id is the query's own and is
    no candidate.  Vectors of another width than the query's have no product with
    it.  Rows of equal ids in ``base`` are candidates of their own; of equal ids in
    ``queries`` one vector is asked.  Scores beyond the range of a long are held at
    its ends, in any order among themselves.  Other columns are not read.
    """
    spark = base.sparkSession
    # written, so that a block of queries is read without another pass over their table
    asked = Scratch(spark, "topk").write(usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")))
    rows = usable(base, id_col, vec_col)
    n = asked.count()
    blocks = -(-n // QUERIES)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect() if n else []
    sample_ids, sample_at = np.array([r[0] for r in sample], np.int64), whole([r[1] for r in sample])
    parts = []
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        ids, by = np.array([r[0] for r in got], np.int64), whole([r[1] for r in got])
        floor = np.full(len(ids), -np.inf)
        for w, (at, q) in by.items():
            if w in sample_at:
                there, points = sample_at[w]
                kind = exact(max(abs(points).max(initial=0), abs(q).max(initial=0)), w)
                if kind is object:
                    continue
                scores = np.where(sample_ids[there][None, :] == ids[at][:, None], -np.inf, q @ points.T)
                if scores.shape[1] >= k:
                    floor[at] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        shared = spark.sparkContext.broadcast((ids, by, floor))
        parts.append(rows.mapInArrow(_searching(shared, k), "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searching(shared, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by, floor = shared.value
        best = [Best(k, float(f)) for f in floor]
        held_ids, held = [], []

        def flush() -> None:
            own = np.array(held_ids, np.int64)
            for w, (at, points) in whole(held).items():
                if w not in by:
                    continue
                places, queries = by[w]
                kind = exact(max(abs(points).max(initial=0), abs(queries).max(initial=0)), w)
                points, queries = (np.vectorize(int, otypes=[object])(x) if kind is object and x.size else x for x in (points, queries))
                tree = Tree(own[at], points)
                bounds = tree.bounds(queries)
                for i, q, bound in zip(places.tolist(), queries, bounds, strict=True):
                    tree.search(q, int(ids[i]), bound, best[i])
            held_ids.clear()
            held.clear()

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                held_ids.append(i)
                held.append(v)
                if len(held) >= SHARD:
                    flush()
        if held:
            flush()
        for i in range(0, len(ids), 1000):
            part = range(i, min(i + 1000, len(ids)))
            sizes = [len(best[j].rows) for j in part]
            if sum(sizes):
                clip = lambda x: min(max(int(x), -(2**63)), 2**63 - 1)
                cols = [np.repeat(ids[list(part)], sizes), np.array([i for j in part for _, i in best[j].rows], np.int64), np.array([clip(-x) for j in part for x, _ in best[j].rows], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return work
