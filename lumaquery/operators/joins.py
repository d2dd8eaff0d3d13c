"""Joins that have no single Spark operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool) -> Column:
    pairs = [left[k].eqNullSafe(right[k]) if null_safe else left[k] == right[k] for k in keys]
    return reduce(lambda a, b: a & b, pairs)


def natural_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all common columns; null keys match null keys."""
    keys = sorted(set(left.columns) & set(right.columns))
    l, r = left.alias("l"), right.alias("r")
    on = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys])
    return l.join(r, on, "left").select("l.*", *[F.col(f"r.`{c}`") for c in right.columns if c not in keys])


def update(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` with the values of ``new`` where these are not null."""
    common = [c for c in old.columns if c in new.columns and c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in common])
    out = old.join(fresh, keys, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in common else F.col(c) for c in old.columns])


def fallback(df: DataFrame, exact: DataFrame, general: DataFrame, keys: list[str], wider: list[str], value: str) -> DataFrame:
    """``value`` by all keys, else by the wider keys."""
    a = exact.select(*keys, F.col(value).alias("_exact"))
    b = general.select(*wider, F.col(value).alias("_general"))
    out = df.join(a, keys, "left").join(b, wider, "left")
    return out.withColumn(value, F.coalesce("_exact", "_general")).drop("_exact", "_general")


def within(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Points with the spans they lie in, ends included.

    Both sides are put into buckets of ``width`` (in the unit of the columns) and
    joined by bucket, so no pair outside a common bucket is looked at.  ``width``
    should be near the spans' usual length.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = spans.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return points.withColumn("_bucket", bucket(at)).join(spread, ["_bucket", *(keys or [])]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def nearest(left: DataFrame, right: DataFrame, at: str, other: str, keys: list[str], take: list[str]) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of the same keys that is nearest; the smaller of two equally near.

    A union of both sides is ordered by key and place; the neighbours before and
    after each left row are the last ones read upwards and downwards, so the work is
    a sort and two passes, not pairwise.
    """
    from pyspark.sql import Window

    payload = F.struct(F.col(other).alias("_r"), *take)
    kind = right.select(*keys, F.col(other).cast("double").alias("_p"), payload.alias("_x")).schema["_x"].dataType.simpleString()
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    rows = left.select(*keys, F.col(at).cast("double").alias("_p"), F.lit(None).cast(kind).alias("_x"), own.alias("_own"))
    blank = F.lit(None).cast(rows.schema["_own"].dataType)
    both = rows.unionByName(right.select(*keys, F.col(other).cast("double").alias("_p"), payload.alias("_x"), blank.alias("_own")))
    # rows of the right side come first at equal places, of several there the smallest last
    tie = [F.col("_own").isNotNull(), F.desc("_x")]
    found = lambda order: F.last("_x", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("_b", found(F.asc("_p"))).withColumn("_a", found(F.desc("_p"))).where("_own is not null")
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_p") - F.col("_b._r") <= F.col("_a._r") - F.col("_p"), F.col("_b")).otherwise(F.col("_a"))
    return out.withColumn("_n", near).select("_own.*", *[F.col(f"_n.{c}").alias(c if c not in left.columns else f"{c}_right") for c in take])


def version(df: DataFrame, changes: DataFrame, at: str, key: str, change: str, before: str, after: str, name: str) -> DataFrame:
    """The value that was valid at the time: ``before`` until the change, ``after`` from then on."""
    out = df.join(changes, key, "left")
    return out.withColumn(name, F.when(F.col(change).isNull() | (F.col(at) < F.col(change)), F.col(before)).otherwise(F.col(after))).drop(change, before, after)


def neighbours(cells: DataFrame, keys: list[str], row: str = "row", col: str = "col", label: str = "label") -> DataFrame:
    """For every label, how many cells of each other label touch it (eight neighbours, each cell counted once)."""
    steps = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    known = cells.where(" and ".join(f"`{c}` is not null" for c in [*keys, row, col, label]))
    moved = known.select(*keys, F.col(label).alias("_l"), F.explode(steps).alias("s"), row, col)
    own = (F.col("s.r") == 0) & (F.col("s.c") == 0)
    moved = moved.select(*keys, F.when(~own, F.col("_l")).alias("_of"), F.when(own, F.col("_l")).alias("_own"), (F.col(row) + F.col("s.r")).alias(row), (F.col(col) + F.col("s.c")).alias(col))
    # a place's own label and those of its neighbours meet by grouping, which, unlike a join, keeps a table dealt by its keys where it is
    places = moved.groupBy(*keys, row, col).agg(F.collect_set("_of").alias("_of"), F.collect_list("_own").alias("_own"))
    pairs = places.where(F.size("_own") > 0).select(*keys, "_of", F.explode("_own").alias(label)).select(*keys, F.explode("_of").alias("of"), label)
    return pairs.where(F.col("of") != F.col(label)).groupBy(*keys, "of", label).agg(F.count("*").alias("n"))


def least_distance(tests: DataFrame, training: DataFrame, key: str, vector: str, block: int = 20_000) -> DataFrame:
    """``key`` and the least Euclidean distance to any training vector, exactly.

    Both sides are dealt into blocks by their vectors' norms (of at most some ``block`` rows where many norms
    are equal).  Vectors are no nearer than their norms, so after each block of tests has met the
    training block of the nearest norms, it meets only those whose norms are within its largest distance
    so far.  A pair of blocks is a task; only the blocks' least and largest norms come to the driver.
    Equal keys count as one, null vectors take no part (their distance is null), and widths must be equal.
    """
    from .dependence import MOST_BLOCKS, _placed

    spark, v = tests.sparkSession, F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    asked = tests.where(v.isNotNull()).select(F.col(key).alias("_key"), v.alias("_v")).withColumn("_norm", norm)
    points = training.where(v.isNotNull()).select(v.alias("_v")).distinct().withColumn("_norm", norm)  # else equal vectors would fill blocks

    def blocks(rows: DataFrame, name: str) -> tuple[DataFrame, list]:
        n = rows.count()
        parts = min(MOST_BLOCKS, max(1, -(-n // block)))
        bounds = sorted(set(rows.agg(F.percentile_approx("_norm", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or [])) if parts > 1 else []
        rows = rows.withColumn("_i", F.col("_v")).withColumn("_b", F.array(*map(F.lit, bounds)).cast("array<double>"))
        placed = _placed(rows, [], "_norm", "_b", name, max(1.0, n / parts)).drop("_i", "_b")
        ends = placed.groupBy(name).agg(F.min("_norm").alias("low"), F.max("_norm").alias("high")).collect()
        return placed, sorted((r.low, r.high, r[name]) for r in ends)

    left, own = blocks(asked, "_s")
    right, others = blocks(points, "_t")
    kind = asked.schema["_key"].dataType.simpleString()
    none = tests.select(key).distinct().select(F.col(key), F.lit(None).cast("double").alias("min_distance"))
    if not own or not others:
        return none

    def meet(pairs: list[tuple]) -> DataFrame:
        table = spark.createDataFrame(pairs, "_s int, _t int")
        sides = [d.join(table, c).groupBy("_s", "_t") for d, c in ((left, "_s"), (right, "_t"))]
        return sides[0].cogroup(sides[1]).applyInPandas(_least, f"_s int, _key {kind}, d double")

    gap = lambda a, b: max(0.0, a[0] - b[1], b[0] - a[1])
    first = {a[2]: min(others, key=lambda b: (gap(a, b), abs(a[0] + a[1] - b[0] - b[1])))[2] for a in own}
    found = meet(list(first.items()))
    worst = {r["_s"]: r.d for r in found.groupBy("_s").agg(F.max("d").alias("d")).collect()}
    more = [(a[2], b[2]) for a in own for b in others if b[2] != first[a[2]] and gap(a, b) <= worst[a[2]] * (1 + 1e-9)]
    if more:
        found = found.unionAll(meet(more))
    least = found.groupBy(F.col("_key")).agg(F.min("d").alias("min_distance"))
    return tests.select(key).distinct().join(least, F.col(f"`{key}`").eqNullSafe(F.col("_key")), "left").select(key, "min_distance")


def _least(a, b):
    """Least distances of one block's rows to another's."""
    import numpy as np
    import pandas as pd

    if not len(a) or not len(b):
        return pd.DataFrame({"_s": a["_s"], "_key": a["_key"], "d": np.full(len(a), np.inf)})
    x, points = np.stack(a["_v"].to_numpy()), np.stack(b["_v"].to_numpy())
    squares, d = (points**2).sum(1), np.empty(len(x))
    for i in range(0, len(x), 256):
        near = (x[i : i + 256] ** 2).sum(1)[:, None] + squares[None, :] - 2 * x[i : i + 256] @ points.T
        d[i : i + 256] = np.sqrt(((x[i : i + 256] - points[near.argmin(1)]) ** 2).sum(1))
    return pd.DataFrame({"_s": a["_s"], "_key": a["_key"], "d": d})
