"""Exact k-means on whole-number vectors with Hamerly's bounds.

Components become floor(1024 x).  A row of the written state holds its vector, its
centroid and two bounds: an upper one on the distance to that centroid and a lower one
on the distance to any other.  A round adds the centroid's drift to the upper bound and
takes the largest drift of the others off the lower bound.  Where the upper bound stays
under the lower one, or under half the way to the nearest other centroid, the assignment
can't change; the other rows, the ambiguous ones, are compared with all centroids in whole
numbers.  Bounds are rounded outwards, so results are those of full scans.

A round is one pass over the state, which is written anew, so a lost executor costs one
round.  Sums of the moved vectors only are gathered, in partial sums of bounded size, and
added to those of the round before.  Only centroids pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .topk import exact

SCALE = 1024
#: Bits of a limb of a sum; sums of any size are exact as sums of limbs.
LIMB = 40
LONG = 2**63 - 1
_STATE = "vec_id {id}, v array<double>, was int, cluster int, upper double, lower double, distance long"


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) of finite doubles: doubles where all are exact, else Python's integers."""
    if np.abs(x).max(initial=0.0) < 2.0**1000:
        return np.floor(x * SCALE)
    return np.array([[int(y) * SCALE if abs(y) >= 2.0**53 else int(np.floor(y * SCALE)) for y in row] for row in x], object)


def squared(points: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of every point to every centroid."""
    most = max([abs(c) for row in centroids for c in row], default=0)
    kind = exact(float(min(2 * max(most, abs(points).max(initial=0)), 10**300)), points.shape[1])
    if kind is object:
        points = np.array([[int(x) for x in row] for row in points], object).reshape(points.shape)
    out = np.empty((len(points), len(centroids)), object if kind is object else np.int64)
    for k, c in enumerate(centroids):
        d = points - np.array(c, kind)
        out[:, k] = (d * d).sum(1)
    return out


def roots(d: np.ndarray | list) -> np.ndarray:
    """Square roots as doubles; numbers beyond the range of doubles have infinity."""
    return np.sqrt(np.array([float(x) if x < 2**1000 else np.inf for x in d]) if np.asarray(d).dtype == object else np.asarray(d, float))


def up(x):
    return x * (1 + 1e-12) + 1e-9


def down(x):
    return x * (1 - 1e-12) - 1e-9


def limbs(x: int) -> list[int]:
    """x as a sum of limb[j] << (LIMB * j)."""
    out = []
    while not -(1 << LIMB) <= x < 1 << LIMB:
        x, low = x >> LIMB, x & ((1 << LIMB) - 1)
        out.append(low)
    return [*out, x]


def vectors(b: pa.RecordBatch) -> np.ndarray:
    v = b.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def assigning(centroids: list[list[int]], drift: list[float], last: bool):
    """One round over rows of the state; ``last`` gives every row its exact distance."""
    gaps = squared(np.array(centroids, object), centroids) if len(centroids) > 1 else None
    half = [down(roots(np.delete(row, k)).min() / 2) for k, row in enumerate(gaps)] if gaps is not None else [np.inf]
    away = [max(drift[:k] + drift[k + 1 :], default=0.0) for k in range(len(drift))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, others, nearest = np.array(drift), np.array(away), np.array(half)
        for b in batches:
            points, n = whole(vectors(b)), b.num_rows
            was = b.column("cluster").to_numpy()
            known = was >= 0
            at = np.where(known, was, 0)
            with np.errstate(invalid="ignore"):  # an infinite bound less an infinite drift is no bound
                upper = np.where(known, up(b.column("upper").to_numpy() + moved[at]), np.inf)
                lower = np.where(known, np.nan_to_num(down(b.column("lower").to_numpy() - others[at]), nan=-np.inf, posinf=np.inf, neginf=-np.inf), -np.inf)
            cluster, distance = was.astype(np.int32), np.zeros(n, np.int64)
            unsure = np.flatnonzero(~(upper < np.maximum(lower, nearest[at])))
            if len(unsure):
                d = squared(points[unsure], centroids)
                found = d.argmin(1)  # of equal ones the first
                cluster[unsure] = found
                own = d[np.arange(len(unsure)), found]
                upper[unsure] = up(roots(own))
                if len(centroids) > 1:
                    rest = d.copy()
                    rest[np.arange(len(unsure)), found] = d.max(1)
                    lower[unsure] = down(roots(rest.min(1)))
                else:
                    lower[unsure] = np.inf
            if last:
                for k in range(len(centroids)):
                    of = np.flatnonzero(cluster == k)
                    distance[of] = [min(int(x), LONG) for x in squared(points[of], [centroids[k]])[:, 0]]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(was.astype(np.int32)), pa.array(cluster), pa.array(upper), pa.array(lower), pa.array(distance)], names=["vec_id", "v", "was", "cluster", "upper", "lower", "distance"])

    return work


def _moves(k: int, width: int):
    """Rows that moved become partial sums: (cluster, dim, limb, value); dim -1 holds counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), object)
        for b in batches:
            points, was, now = whole(vectors(b)), b.column("was").to_numpy(), b.column("cluster").to_numpy()
            if points.dtype == object or np.abs(points).max(initial=0) * len(points) >= 2.0**53:
                points = np.array([[int(x) for x in row] for row in points], object).reshape(len(points), width)
            for c in range(k):
                for rows, sign in ((now == c, 1), (was == c, -1)):
                    total[c, :width] += [sign * int(x) for x in points[rows].sum(0)] if rows.any() else 0
                    total[c, width] += sign * int(rows.sum())
        rows = [(c, j if j < width else -1, i, x) for c in range(k) for j in range(width + 1) if total[c, j] for i, x in enumerate(limbs(total[c, j]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "dim", "limb", "value"])

    return work


def kmeans(df: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every vector.

    Vectors of another width, null ones and those with null or non-finite components take no
    part.  The centroids start as the k vectors of smallest sha256 of ``seed:id``; equal ids go
    by their vectors, rows without an id come last, and fewer vectors are as many centroids.
    Rows of the same id are clustered each.  Squared distances and sums of them beyond a long
    are held at its end, though assignments are exact.  No vector, no row.  Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "kmeans")
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == width) & fine).select(F.col(id_col).alias("vec_id"), v.alias("v"))
    schema = _STATE.format(id=kept.schema["vec_id"].dataType.simpleString())
    empty = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(kept.schema["vec_id"].dataType.simpleString())
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], empty)
    centroids = [[int(x) for x in row] for row in whole(np.array([r.v for r in seeds], float))]
    k = len(centroids)
    far = F.lit(float("inf"))
    state = kept.select("vec_id", "v", F.lit(-1).alias("was"), F.lit(-1).alias("cluster"), far.alias("upper"), (-far).alias("lower"), F.lit(0).cast("long").alias("distance"))
    drift, sums = [0.0] * k, np.zeros((k, width + 1), object)
    before = None
    for r in range(rounds + 1):
        state = scratch.write(state.mapInArrow(assigning(centroids, drift, r == rounds), schema))
        if before is not None:
            scratch.drop(before)  # at most two states at a time
        before = state
        if r == rounds:
            break
        partial = state.where("cluster <> was").mapInArrow(_moves(k, width), "cluster int, dim int, limb int, value long")
        for row in partial.groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect():  # k x (width + 1) sums
            sums[row.cluster, row.dim] += row.value << (LIMB * row.limb)
        moved = [[s // n for s in row[:width]] if (n := row[width]) else old for row, old in zip(sums.tolist(), centroids, strict=True)]
        drift = [up(float(roots(squared(np.array([old], object), [new])[0])[0])) for old, new in zip(centroids, moved, strict=True)]
        centroids = moved
    each = {row.cluster: row.total for row in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    clip = lambda x: min(int(x), LONG)
    totals = F.create_map(*[F.lit(y) for c, total in each.items() for y in (c, clip(total))])
    names = F.array(*map(F.lit, texts))
    inertia = F.lit(clip(sum(each.values()))).cast("long")
    return state.select("vec_id", "cluster", "distance", totals[F.col("cluster")].cast("long").alias("cluster_inertia"), inertia.alias("inertia"), F.get(names, "cluster").alias("centroid_sha256"))
