"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Entries become whole numbers, floor(64 c) + 1000000.  The fit list holds each distinct
vector once.  Every partition multiplies the list's residues by several primes: products
of residues under 2 ** 20 over blocks of 8192 rows stay below 2 ** 53, so that products of
matrices of doubles are exact.  With a column of ones beside the entries one such product
holds counts, sums and products alike.  Spark sums the residues of all partitions, and the
Chinese remainder theorem gives the exact sums from them; n sum(x y) - sum(x) sum(y) is the
scatter about the mean, times n, without rounding.  Only d x d numbers pass the driver,
which takes their eigenvectors in doubles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

STEP, SHIFT = 64, 1_000_000
#: Entries are held within these bounds, so that they fit in a long.
MOST = 2**62
TOP = 2**20
BLOCK = 8192
COMPONENTS = 16
LONG = 2**63 - 1
#: Columns of a row of partial sums.
CHUNK = 64


@functools.cache
def primes(n: int) -> list[int]:
    """The n largest primes under ``TOP``."""
    out, x = [], TOP - 1
    while len(out) < n:
        if all(x % d for d in range(3, int(x**0.5) + 1, 2)):
            out.append(x)
        x -= 2
    return out


def needed(bound: int) -> list[int]:
    """Enough primes to tell apart all whole numbers between -bound and bound."""
    n, product = 0, 1
    while product <= 2 * bound:
        n += 1
        product = int(np.prod(np.array(primes(n), object)))
    return primes(n)


def remaindered(residues: list[np.ndarray], mods: list[int]) -> np.ndarray:
    """The whole numbers nearest to zero that have these residues (Chinese remainder theorem)."""
    product = int(np.prod(np.array(mods, object)))
    total = np.zeros(residues[0].shape, object)
    for r, p in zip(residues, mods, strict=True):
        rest = product // p
        total += r.astype(object) % p * (rest * pow(rest, -1, p))
    total %= product
    return np.where(total * 2 > product, total - product, total)


def matrix(b: pa.RecordBatch, name: str = "x") -> np.ndarray:
    x = b.column(name)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _chunked(parts: list[np.ndarray], kind) -> pa.RecordBatch:
    """Matrices as rows (part, row, chunk, values), each of at most ``CHUNK`` values."""
    rows = [(p, i, c // CHUNK, m[i, c : c + CHUNK].tolist()) for p, m in enumerate(parts) for i in range(m.shape[0]) for c in range(0, m.shape[1], CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(kind))], names=["part", "i", "chunk", "values"])


def _summed(partial: DataFrame, parts: int, shape: tuple[int, int], kind) -> list[np.ndarray]:
    """The sums of all tasks' matrices; parts x rows x columns of them come to the driver."""
    sums = [F.sum(F.get("values", F.lit(j))).alias(f"s{j}") for j in range(min(CHUNK, shape[1]))]
    out = [np.zeros(shape, kind) for _ in range(parts)]
    for r in partial.groupBy("part", "i", "chunk").agg(*sums).collect():
        values = [x for x in r[3:] if x is not None]
        out[r.part][r.i, r.chunk * CHUNK : r.chunk * CHUNK + len(values)] = values
    return out


def residue_scatter(mods: list[int], width: int):
    """A partition's products of (1, x) with itself, by each prime."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((width + 1, width + 1), np.int64) for _ in mods]
        for b in batches:
            x = matrix(b)
            for at in range(0, len(x), BLOCK):
                rows = np.hstack([np.ones((len(x[at : at + BLOCK]), 1), np.int64), x[at : at + BLOCK]])
                for t, p in zip(total, mods, strict=True):
                    r = (rows % p).astype(float)
                    t += (r.T @ r).astype(np.int64) % p
                    t %= p
        yield _chunked(total, pa.int64())

    return work


class Fit:
    """Count, sums, eigenvalues and components of a fit list."""

    def __init__(self, gram: np.ndarray, keep: int):
        self.n, self.sums = int(gram[0, 0]), [int(x) for x in gram[0, 1:]]
        s = np.array(self.sums, object)
        scatter = self.n * gram[1:, 1:] - np.outer(s, s)
        square = self.n * self.n
        cov = np.array([[int(x) / square for x in row] for row in scatter])  # each rounded once
        self.trace = sum(int(scatter[i, i]) for i in range(len(s))) / square
        values, vecs = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[:keep]
        self.values, self.vecs = values[order], vecs[:, order]
        least = len(s) * np.finfo(float).eps * max(float(values[-1]), 0.0)
        self.sure = self.values > least  # directions in which the list has no spread can't be whitened
        self.scale = np.where(self.sure, 1 / np.sqrt(np.where(self.sure, self.values, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        s = np.array(self.sums, object)
        if self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0) < 2**62:
            return x * self.n - s.astype(np.int64)
        return x.astype(object) * self.n - s

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        mean = centred.astype(float) / self.n if centred.dtype != object else np.array([[int(y) / self.n for y in row] for row in centred], float).reshape(centred.shape)
        return mean @ self.vecs * self.scale


def _moments(fit: Fit):
    """A partition's sums of (1, w) with itself, w being the whitened rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fit.vecs.shape[1]
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            w = fit.whitened(fit.centred(matrix(b)))
            w = np.hstack([np.ones((len(w), 1)), w])
            total += w.T @ w
        yield _chunked([total], pa.float64())

    return work


def _projected(fit: Fit, error: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fit.vecs.shape[1]
        share = fit.values / fit.trace if fit.trace else np.zeros(k)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                c = fit.centred(matrix(part))
                n, w = len(c), fit.whitened(c)
                most = int(np.abs(c).max(initial=0))
                far = (c * c).sum(1) if c.dtype == object or most * most * c.shape[1] < 2**62 else (c.astype(object) ** 2).sum(1)
                deviation = pa.array([min(int(x), LONG) for x in far], pa.int64())
                no = np.tile(~fit.sure, n)
                again = pa.array(np.repeat(np.arange(n), k))
                columns = [
                    part.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, fit.n)), deviation.take(again),
                    pa.array(w.ravel(), pa.float64(), mask=no), pa.array(np.tile(share, n)), pa.array(np.full(n * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return work


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    A row for each vector and each of the first ``components`` components (as many as the vector has
    entries, if fewer).  Null vectors and those with null or non-finite entries take no part; empty
    vectors have no component.  Vectors of different widths have fits of their own.  Rows of equal or
    null ids stay each.  Entries whose whole number passes 2 ** 62 are held there, deviations at a
    long's end.  ``whitened`` is null in a component along which the fit list has no spread, and that
    component is left out of ``identity_error``.  Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "whitening")
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    entry = lambda c: F.greatest(F.least(F.floor(c * STEP), F.lit(MOST)), F.lit(-MOST)) + SHIFT
    rows = df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fine).select(F.col(id_col).alias("vec_id"), F.transform(v, entry).alias("x"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit_list = scratch.write(rows.select("x").groupBy("x").agg(F.size("x").alias("width")))
    size = F.array_max(F.transform("x", lambda y: F.abs(y)))
    widths = fit_list.groupBy("width").agg(F.count("*").alias("n"), F.max(size).alias("most")).orderBy("width").collect()
    out = spark.createDataFrame([], schema)
    for r in widths:
        own = fit_list.where(F.col("width") == r.width).select("x")
        mods = needed(r.n * max(r.most, 1) ** 2)
        gram = remaindered(_summed(own.mapInArrow(residue_scatter(mods, r.width), "part int, i int, chunk int, values array<long>"), len(mods), (r.width + 1,) * 2, np.int64), mods)
        fit = Fit(gram, min(components, r.width))
        k = fit.vecs.shape[1]
        total = _summed(own.mapInArrow(_moments(fit), "part int, i int, chunk int, values array<double>"), 1, (k + 1, k + 1), float)[0]
        mean = total[0, 1:] / fit.n
        off = (total[1:, 1:] / fit.n - np.outer(mean, mean) - np.eye(k))[np.ix_(fit.sure, fit.sure)]
        found = rows.where(F.size("x") == r.width).mapInArrow(_projected(fit, float(np.abs(off).max(initial=0.0))), schema)
        out = found if r is widths[0] else out.unionAll(found)
    return out
