"""Distance correlation of two columns: in n log n work for numbers, by blocks of rows for vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, and the most blocks of a group's rows in one order.
BLOCK, MOST_BLOCKS = 100_000, 256


def smaller_sums(first: np.ndarray, second: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the sums of ``values`` over the rows that come before it in both orders.

    ``first`` holds whole numbers from 0, equal ones don't count as before; ``second`` orders by
    value, equal ones by their place.  Bit by bit of ``first``: of the rows that agree in all higher
    bits, those with a 0 come before those with a 1, so running sums in the second order do.
    """
    out, by = np.zeros_like(values), np.argsort(second, kind="stable")
    for b in range(int(first.max(initial=0)).bit_length()):
        order = by[np.argsort(first[by] >> (b + 1), kind="stable")]
        node, one = first[order] >> (b + 1), (first[order] >> b) & 1 == 1
        left = np.where(one[:, None], 0.0, values[order])
        run = np.cumsum(left, axis=0)
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        before = np.repeat((run[start] - left[start]), np.diff(np.append(start, len(order))), axis=0)
        out[order[one]] += (run - before)[one]
    return out


def products(x, y, count, sx, sy, sxy):
    """The sum over earlier points i of (x - x_i)(y - y_i), from their count and sums."""
    return x * y * count - x * sy - y * sx + sxy


def row_sums(v: np.ndarray, before: np.ndarray, sum_before: np.ndarray, n: float, total: float) -> np.ndarray:
    """The sum of |v - v_i| over all points, from what comes before in v's order."""
    return v * (2 * before - n) + total - 2 * sum_before


def _bin(value: str, bounds: str) -> Column:
    """Between which bounds a value lies; values equal to a bound have bins of their own."""
    return 2 * F.size(F.filter(bounds, lambda b: b < F.col(value))) + F.array_contains(bounds, F.col(value)).cast("int")


def _placed(rows: DataFrame, keys: list[str], value: str, bounds: str, name: str, block: float) -> DataFrame:
    """Rows with the number of their block in the order of ``value``; many equal values are dealt into several."""
    binned = rows.withColumn("_bin", _bin(value, bounds))
    sizes = binned.groupBy(*keys, "_bin").agg(F.when(F.col("_bin") % 2 == 1, F.ceil(F.count("*") / block)).otherwise(1).cast("int").alias("_k"))
    first = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_first", first)
    own = F.pmod(F.xxhash64("_i"), F.col("_k"))
    return _joined(binned, sizes, [*keys, "_bin"]).withColumn(name, (F.col("_first") + own).cast("int")).drop("_bin", "_k", "_first")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Left rows with what the right side (each key once) has for their keys; null keys match."""
    renamed = right.withColumnsRenamed({k: f"_r_{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_r_{i}"))
    return left.join(renamed, on, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def _before(rows: DataFrame, keys: list[str], block: str, names: dict[str, Column]) -> DataFrame:
    """Sums over all earlier blocks of a group."""
    each = rows.groupBy(*keys, block).agg(*[c.alias(n) for n, c in names.items()])
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*keys, block, *[F.coalesce(F.sum(n).over(w), F.lit(0.0)).alias(n) for n in names])


def _scalars(df: DataFrame, keys: list[str], row: str, x: str, y: str, block: int) -> DataFrame:
    """Sums of products of distances and of rows' sums, from running sums.

    Points are put into blocks by the order of x and by the order of y.  Pairs in the same block of x
    are summed in that block's task, pairs in different blocks of x and the same of y in the y block's
    task, and all other pairs from sums of cells (block of x, block of y).
    """
    rows = df.select(*keys, F.col(row).alias("_i"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    blocks = min(MOST_BLOCKS, max(1, -(-n // block)))
    quantiles = lambda c: F.array_distinct(F.percentile_approx(c, [i / blocks for i in range(1, blocks)], 10 * blocks)) if blocks > 1 else F.array().cast("array<double>")
    whole = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("_n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), quantiles("_x").alias("_bx"), quantiles("_y").alias("_by"))
    rows = _joined(rows, whole, keys)
    rows = _placed(rows, keys, "_x", "_bx", "_p", max(1.0, n / blocks))
    rows = _placed(rows, keys, "_y", "_by", "_q", max(1.0, n / blocks))
    rows = rows.select(*keys, "_n", "_p", "_q", (F.col("_x") - F.col("_mx")).alias("_x"), (F.col("_y") - F.col("_my")).alias("_y"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    kinds = f"{kinds}, " if kinds else ""
    sums = {"_cn": F.count("*").cast("double"), "_cx": F.sum("_x"), "_cy": F.sum("_y"), "_cxy": F.sum(F.col("_x") * F.col("_y"))}

    # cells: pairs of which one is before in both orders, in other blocks of both
    cells = rows.groupBy(*keys, "_p", "_q").agg(*[c.alias(k) for k, c in sums.items()])
    along = Window.partitionBy(*keys, "_p").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    every = rows.select(*keys, "_q").distinct()
    full = rows.select(*keys, "_p").distinct()
    grid = _joined(full.withColumn("_1", F.lit(1)), every.withColumn("_1", F.lit(1)), [*keys, "_1"]).drop("_1")  # at most some MOST_BLOCKS squared a group
    grid = _joined(grid, cells, [*keys, "_p", "_q"], "left").na.fill(0.0, list(sums))
    lower = grid.select(*keys, "_p", "_q", *sums, *[F.coalesce(F.sum(c).over(along), F.lit(0.0)).alias(f"{c}_l") for c in sums])
    up = Window.partitionBy(*keys, "_q").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    lower = lower.select(*keys, *sums, *[F.coalesce(F.sum(f"{c}_l").over(up), F.lit(0.0)).alias(f"{c}_b") for c in sums])
    c = F.col
    between = 2 * (c("_cxy") * c("_cn_b") - c("_cx") * c("_cy_b") - c("_cy") * c("_cx_b") + c("_cn") * c("_cxy_b"))
    cross = lower.select(*keys, between.alias("_s"))

    # blocks of y: the rows' sums of distances in y, and pairs of other blocks of x
    before_y = _before(rows, keys, "_q", {"_bn": sums["_cn"], "_bs": sums["_cy"]})

    def in_y(pdf: pd.DataFrame) -> pd.DataFrame:
        v, w = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
        order = np.argsort(w, kind="stable")
        at, run = np.empty(len(w)), np.empty(len(w))
        at[order], run[order] = np.arange(len(w)), np.cumsum(w[order]) - w[order]
        b = row_sums(w, at + pdf["_bn"].iloc[0], run + pdf["_bs"].iloc[0], pdf["_n"].iloc[0], 0.0)
        d = smaller_sums(pdf["_p"].to_numpy().astype(np.int64), w, np.column_stack([np.ones(len(v)), v, w, v * w]))
        out = pdf[[*keys, "_n", "_p", "_x", "_y"]].assign(_b=b, _s=0.0)
        out["_s"] = 2 * products(v, w, *d.T)
        return out

    task = _joined(rows, before_y, [*keys, "_q"])
    # the points' deviations from their mean add up to nothing, so totals are left out
    with_b = task.groupBy(*keys, "_q").applyInPandas(in_y, f"{kinds}_n double, _p int, _x double, _y double, _b double, _s double")
    before_x = _before(rows, keys, "_p", {"_bn": sums["_cn"], "_bx": sums["_cx"], "_by": sums["_cy"], "_bxy": sums["_cxy"]})

    def in_x(pdf: pd.DataFrame) -> pd.DataFrame:
        v, w, n = pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["_n"].iloc[0]
        order = np.argsort(v, kind="stable")
        place = np.empty(len(v), np.int64)
        place[order] = np.arange(len(v))
        values = np.column_stack([np.ones(len(v)), v, w, v * w])
        prefix = (np.cumsum(values[order], axis=0) - values[order])[np.argsort(order)] + pdf[["_bn", "_bx", "_by", "_bxy"]].iloc[0].to_numpy(float)
        a, b = row_sums(v, prefix[:, 0], prefix[:, 1], n, 0.0), pdf["_b"].to_numpy()
        s = 2 * products(v, w, *smaller_sums(place, w, values).T) - products(v, w, *prefix.T) + pdf["_s"].to_numpy()
        one = {"_s": s.sum(), "n": float(len(v)), "rab": (a * b).sum(), "raa": (a * a).sum(), "rbb": (b * b).sum(), "_a": a.sum(), "_b": b.sum(), "vx": v.sum(), "vy": w.sum(), "vxx": (v * v).sum(), "vyy": (w * w).sum()}
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | one])

    names = ["_s", "n", "rab", "raa", "rbb", "_a", "_b", "vx", "vy", "vxx", "vyy"]
    parts = _joined(with_b, before_x, [*keys, "_p"]).groupBy(*keys, "_p").applyInPandas(in_x, kinds + ", ".join(f"{x} double" for x in names))
    every = parts.unionByName(cross, allowMissingColumns=True).groupBy(*keys).agg(*[F.sum(x).alias(x) for x in names])
    return every.select(*keys, "n", (2 * c("_s")).alias("_ab"), (2 * c("n") * c("vxx") - 2 * c("vx") * c("vx")).alias("_aa"), (2 * c("n") * c("vyy") - 2 * c("vy") * c("vy")).alias("_bb"), "rab", "raa", "rbb", "_a", "_b")


def distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of u to all rows of v."""
    if u.shape[1] == 1:
        return np.abs(u - v.T)
    return np.sqrt(((u[:, None, :] - v[None, :, :]) ** 2).sum(2))


def _vectors(df: DataFrame, keys: list[str], row: str, x: str, y: str, block: int) -> DataFrame:
    """The same sums by pairs of blocks of rows: each is a task, which gives sums and no distances."""
    column = lambda c: F.col(c).cast("array<double>") if isinstance(df.schema[c].dataType, T.ArrayType) else F.array(F.col(c).cast("double"))
    point = df.select(*keys, F.col(row).alias("_i"), column(x).alias("_x"), column(y).alias("_y"))
    sizes = point.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_k"))
    placed = _joined(point, sizes, keys).withColumn("_c", F.pmod(F.xxhash64("_i"), "_k").cast("int"))
    pairs = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    pairs = pairs.select(*keys, "_i", "_x", "_y", "_c", F.least("_c", "_o").alias("_p"), F.greatest("_c", "_o").alias("_q"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    kinds = f"{kinds}, " if kinds else ""
    kind = point.schema["_i"].dataType.simpleString()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        low = (pdf["_c"] == pdf["_p"].iloc[0]).to_numpy()
        u, same = pdf[low], pdf["_p"].iloc[0] == pdf["_q"].iloc[0]
        v = u if same else pdf[~low]
        ids, ab = [*u["_i"], *(() if same else v["_i"])], np.zeros(3)
        each = [np.zeros(len(u)), np.zeros(len(u)), np.zeros(len(v)), np.zeros(len(v))]
        (ux, vx), (uy, vy) = ([np.stack(d[c].to_numpy()) if len(d) else np.zeros((0, 1)) for d in (u, v)] for c in ("_x", "_y"))
        for i in range(0, len(u), 64):
            a, b = distances(ux[i : i + 64], vx) if len(v) else np.zeros((0, 0)), distances(uy[i : i + 64], vy) if len(v) else np.zeros((0, 0))
            if not len(v):
                break
            ab += [(a * b).sum(), (a * a).sum(), (b * b).sum()]
            each[0][i : i + 64], each[1][i : i + 64] = a.sum(1), b.sum(1)
            each[2] += a.sum(0)
            each[3] += b.sum(0)
        sums = [each[0], each[1]] if same else [np.append(each[0], each[2]), np.append(each[1], each[3])]
        out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"_i": ids, "_a": sums[0], "_b": sums[1]})
        for name, value in zip(("_ab", "_aa", "_bb"), ab if same else 2 * ab, strict=True):
            out[name] = [value] + [0.0] * (len(out) - 1)
        return out

    parts = pairs.groupBy(*keys, "_p", "_q").applyInPandas(work, f"{kinds}_i {kind}, _a double, _b double, _ab double, _aa double, _bb double")
    rows = parts.groupBy(*keys, "_i").agg(*[F.sum(c).alias(c) for c in ("_a", "_b", "_ab", "_aa", "_bb")])
    squares = [F.sum(F.col(p) * F.col(q)).alias(n) for n, p, q in (("rab", "_a", "_b"), ("raa", "_a", "_a"), ("rbb", "_b", "_b"))]
    return rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(c) for c in ("_a", "_b", "_ab", "_aa", "_bb")], *squares)


def distance_correlation(df: DataFrame, keys: list[str], row: str, x: str, y: str, block: int | None = None) -> DataFrame:
    """``dcor`` of two columns in each group, by doubly centred distances; 0 where a column has one value only.

    ``row`` names the rows of a group.  Columns of numbers take n log n work in blocks of some ``block`` rows
    (``BLOCK``); where one is an array of numbers, Euclidean distances are taken by pairs of blocks
    of ``block`` rows (2048), n squared work in tasks of bounded size.  Rows with a null in
    either column are left out.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    vectors = any(isinstance(df.schema[c].dataType, T.ArrayType) for c in (x, y))
    s = _vectors(rows, keys, row, x, y, block or 2048) if vectors else _scalars(rows, keys, row, x, y, block or BLOCK)
    n = F.col("n")
    # mean of products of doubly centred distances, from sums alone
    centred = lambda p, r, u, v: F.col(p) / (n * n) - 2 * F.col(r) / (n * n * n) + F.col(u) * F.col(v) / (n * n * n * n)
    s = s.select(*keys, centred("_ab", "rab", "_a", "_b").alias("ab"), centred("_aa", "raa", "_a", "_a").alias("aa"), centred("_bb", "rbb", "_b", "_b").alias("bb"))
    whole = F.sqrt(F.sqrt(F.greatest("aa", F.lit(0.0)) * F.greatest("bb", F.lit(0.0))))
    return s.select(*keys, F.coalesce(F.try_divide(F.sqrt(F.greatest("ab", F.lit(0.0))), whole), F.lit(0.0)).alias("dcor"))
