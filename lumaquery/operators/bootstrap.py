"""Seeded resampling: metrics, rankings and hierarchies.

Draws come from hashes of (seed, bootstrap, place), so a task that runs again
draws the same, and every algorithm of a task gets the same cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts: the first 52 bits of the md5 of their text, so that any engine can draw it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Ranges of random keys that rows are numbered by.
RANGES = 1024


def numbered(df: DataFrame, u: Column, tie: list[str], name: str, keys: list[str] = ()) -> DataFrame:
    """Rows numbered from 0 in the order of a random key in [0, 1), of all rows or of each group.

    Keys are ranked within ranges of ``u``, and the ranges' sizes are added up, so no task
    gets all rows of a group.
    """
    rows = df.withColumn("_u", u).withColumn("_range", F.floor(F.col("_u") * RANGES).cast("int"))
    sizes = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_range", before.alias("_before"))  # RANGES rows a group
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_u", *tie)) - 1
    return rows.withColumn("_place", place).join(sizes, [*keys, "_range"]).withColumn(name, F.col("_before") + F.col("_place")).drop("_u", "_range", "_place", "_before")


#: Units that one task puts in order; more are ranked by ranges.
LOT = 50_000


def places(df: DataFrame, keys: list[str], unit: str, lot: int = LOT) -> tuple[DataFrame, int]:
    """(keys, unit, _p, _n): each group's different units numbered from 0 in their order, and how many it has; and the number of rows.

    More units than ``lot`` are ranked within ranges of the unit, and the ranges' sizes are added up.  Bounds
    are some of the units, picked by hash; they only say which task ranks a unit.
    """
    units = df.select(*keys, unit).distinct()
    n, w = units.count(), Window.partitionBy(*keys)
    if n <= lot:
        return units.withColumn("_p", F.row_number().over(w.orderBy(unit)) - 1).withColumn("_n", F.count("*").over(w)), n
    some = units.select(unit).where(F.col(unit).isNotNull() & (F.pmod(F.xxhash64(unit), F.lit(max(1, n // max(4096, 20 * n // lot)))) == 0)).distinct()
    seen = [r[0] for r in some.orderBy(unit).collect()]  # 20 a range
    step = max(1, len(seen) * lot // n)
    bounds = seen[step::step]
    rows = units.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(unit))) if bounds else F.lit(0))
    sizes = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_range", before.alias("_before"), F.sum("_size").over(w).alias("_n"))  # the ranges of a group
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(unit)) - 1
    ranked = rows.repartition(len(bounds) + 1, *keys, "_range").withColumn("_i", inside).join(sizes, [*keys, "_range"])
    return ranked.select(*keys, unit, (F.col("_before") + F.col("_i")).cast("int").alias("_p"), "_n"), n


def picks(placed: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """(keys, bootstrap, draw, _p): the places that n bootstraps of as many draws as there are units take."""
    draws = placed.select(*keys, F.col("_p").alias("draw"), "_n").withColumn("bootstrap", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pick = F.floor(uniform(seed, *map(F.col, keys), F.col("bootstrap"), F.col("draw")) * F.col("_n")).cast("int")
    return draws.select(*keys, "bootstrap", "draw", pick.alias("_p"))


def resampled(df: DataFrame, keys: list[str], unit: str, n: int, seed: int = 0) -> DataFrame:
    """(keys, bootstrap, draw, unit): as many draws with replacement from each group's units as it has, n times."""
    placed, _ = places(df, keys, unit)
    return picks(placed, keys, n, seed).join(placed.drop("_n"), [*keys, "_p"]).drop("_p")


def bootstrapped(df: DataFrame, keys: list[str], unit: str, metric: Column, n: int = 1000, seed: int = 0, name: str = "metric") -> DataFrame:
    """A metric (an aggregate over the drawn units' rows) for each bootstrap."""
    draws = resampled(df, keys, unit, n, seed)
    return draws.join(df, [*keys, unit]).groupBy(*keys, "bootstrap").agg(metric.alias(name))


def interval(df: DataFrame, keys: list[str], name: str = "metric") -> DataFrame:
    """Mean, median, sample deviation and 95 % interval of bootstrapped values, NaN left out."""
    x = F.nanvl(F.col(name), F.lit(None).cast("double"))
    ends = F.percentile(x, F.array(F.lit(0.025), F.lit(0.975)))
    out = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), ends.alias("_e"))
    return out.select(*keys, "mean", "median", "std", F.col("_e")[0].alias("low"), F.col("_e")[1].alias("high"))


def checked_cases(df: DataFrame, task: str, algorithm: str, case: str, value: str) -> DataFrame:
    """The table, or an error for repeated cases, NaN, fewer than two algorithms or unequal cases."""
    rows = df.groupBy(task, algorithm, case).agg(F.count("*").alias("_k"), F.any_value(value).alias(value))
    sizes = rows.groupBy(task, algorithm).agg(F.count("*").alias("_n"))
    shape = sizes.groupBy(task).agg(F.count("*").alias("_a"), F.min("_n").alias("_lo"))
    whole = rows.groupBy(task).agg(F.count_distinct(case).alias("_all"))
    bad = F.when(F.col("_k") > 1, "repeated case").when(F.col(value).isNull() | F.isnan(value), "missing value").when(F.col("_a") < 2, "fewer than two algorithms").when(F.col("_lo") < F.col("_all"), "unequal cases")
    out = rows.join(shape, task).join(whole, task)
    return out.select(task, algorithm, case, F.when(bad.isNull(), F.col(value)).otherwise(F.raise_error(bad).cast("double")).alias(value))


def ranking(df: DataFrame, task: str, algorithm: str, case: str, value: str, n: int = 1000, seed: int = 0, larger_is_better: bool = True, subject: str | None = None) -> DataFrame:
    """(task, bootstrap, algorithm, score, rank): algorithms ranked on the same resampled cases.

    With ``subject`` the subjects are drawn and each counts with the mean of its cases.
    """
    if subject:
        df = df.groupBy(task, algorithm, F.col(subject).alias(case)).agg(F.avg(value).alias(value))
    rows = checked_cases(df, task, algorithm, case, value)
    draws = resampled(rows, [task], case, n, seed)
    scores = draws.join(rows, [task, case]).groupBy(task, "bootstrap", algorithm).agg(F.avg(value).alias("score"))
    order = F.desc("score") if larger_is_better else F.asc("score")
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(task, "bootstrap").orderBy(order)))


def rank_counts(ranked: DataFrame, task: str, algorithm: str) -> DataFrame:
    return ranked.groupBy(task, algorithm, "rank").agg(F.count("*").alias("n"))


def rank_statistics(ranked: DataFrame, task: str, algorithm: str) -> DataFrame:
    """Mean, median, deviation and the closest observations to the ends of the 95 % interval."""
    w = Window.partitionBy(task, algorithm).orderBy("rank", "bootstrap")
    rows = ranked.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(task, algorithm)))
    # the observation whose place is nearest to q n, of two the even one
    place = lambda q: F.greatest(F.lit(1), F.bround(F.lit(q) * F.col("_n")).cast("long"))
    at = lambda q: F.max(F.when(F.col("_i") == place(q), F.col("rank")))
    return rows.groupBy(task, algorithm).agg(F.avg("rank").alias("mean"), F.median("rank").alias("median"), F.stddev_pop("rank").alias("std"), at(0.025).alias("low"), at(0.975).alias("high"))


def hierarchical(df: DataFrame, domain: str, subject: str, image: str, n: int, subjects: int, images: int, seed: int = 0) -> DataFrame:
    """(bootstrap, domain, subject, image): every domain, ``subjects`` of its subjects and ``images`` of each one's images, with replacement."""
    pool = df.select(domain, subject, image).distinct()
    s = pool.select(domain, subject).distinct()
    wd, ws = Window.partitionBy(domain), Window.partitionBy(domain, subject)
    s = s.withColumn("_p", F.row_number().over(wd.orderBy(subject)) - 1).withColumn("_n", F.count("*").over(wd))
    i = pool.withColumn("_q", F.row_number().over(ws.orderBy(image)) - 1).withColumn("_m", F.count("*").over(ws))
    draws = s.groupBy(domain).agg(F.max("_n").alias("_n")).withColumn("bootstrap", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(subjects - 1))))
    draws = draws.withColumn("_p", F.floor(uniform(seed, F.col(domain), F.col("bootstrap"), F.col("_k")) * F.col("_n")).cast("int"))
    chosen = draws.join(s.drop("_n"), [domain, "_p"]).join(i.groupBy(domain, subject).agg(F.max("_m").alias("_m")), [domain, subject])
    chosen = chosen.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(images - 1)))).withColumn("_q", F.floor(uniform(seed + 1, F.col(domain), F.col("bootstrap"), F.col("_k"), F.col("_j")) * F.col("_m")).cast("int"))
    return chosen.join(i.drop("_m"), [domain, subject, "_q"]).select("bootstrap", domain, subject, image)


def balanced(df: DataFrame, label: str, unit: str, n: int, size: int, seed: int = 0) -> DataFrame:
    """(bootstrap, draw, label, unit): labels in turn, a unit of the label drawn for each."""
    pool = df.select(label, unit).distinct()
    names = pool.select(label).distinct().withColumn("_l", F.row_number().over(Window.orderBy(label)) - 1)
    total = names.agg(F.count("*").alias("_total"))
    w = Window.partitionBy(label)
    placed = pool.withColumn("_p", F.row_number().over(w.orderBy(unit)) - 1).withColumn("_n", F.count("*").over(w)).join(names, label)
    draws = df.sparkSession.range(n * size).select((F.col("id") / size).cast("int").alias("bootstrap"), (F.col("id") % size).cast("int").alias("draw"))
    draws = draws.withColumn("_l", F.pmod("draw", total.scalar()).cast("int")).join(placed.groupBy("_l").agg(F.max("_n").alias("_n")), "_l")
    draws = draws.withColumn("_p", F.floor(uniform(seed, F.col("bootstrap"), F.col("draw")) * F.col("_n")).cast("int"))
    return draws.join(placed.drop("_n"), ["_l", "_p"]).select("bootstrap", "draw", label, unit)


def oversampled(df: DataFrame, label: str, unit: str, n: int, size: int, seed: int = 0) -> DataFrame:
    """As ``balanced``, but each draw takes a unit of the label drawn least so far, counting all labels a unit has.

    The count runs on from draw to draw within a bootstrap, so each bootstrap is
    one sequence; bootstraps are drawn in parallel.  The count depends on a unit's
    set of labels alone, so only the sets and their sizes are broadcast (as many as
    there are combinations of labels); the drawn places are then joined to the units.
    """
    units = df.groupBy(unit).agg(F.sort_array(F.collect_set(label)).alias("labels"))
    w = Window.partitionBy("labels")
    placed = units.withColumn("_p", F.row_number().over(w.orderBy(unit)) - 1)
    sets = units.groupBy("labels").agg(F.count("*").alias("n")).collect()
    shared = df.sparkSession.sparkContext.broadcast(sorted((tuple(r[0]), r[1]) for r in sets))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        names = sorted({x for ls, _ in table for x in ls})
        having = {x: [(ls, n) for ls, n in table if x in ls] for x in names}
        ends = {x: np.cumsum([n for _, n in having[x]]) for x in names}
        for pdf in parts:
            for b in pdf["id"]:
                rng, seen, rows = np.random.default_rng([seed, int(b)]), dict.fromkeys(names, 0), []
                for d in range(size):
                    least = min(names, key=lambda x: (seen[x], x))
                    at = int(rng.integers(ends[least][-1]))
                    k = int(np.searchsorted(ends[least], at, side="right"))
                    labels, size_of = having[least][k]
                    for x in labels:
                        seen[x] += 1
                    rows.append((int(b), d, least, list(labels), int(at - ends[least][k] + size_of)))
                yield pd.DataFrame(rows, columns=["bootstrap", "draw", label, "labels", "_p"])

    kind = df.schema[label].dataType.simpleString()
    drawn = df.sparkSession.range(n).mapInPandas(work, f"bootstrap long, draw long, {label} {kind}, labels array<{kind}>, _p int")
    return drawn.join(placed, ["labels", "_p"]).select("bootstrap", "draw", label, unit)


def weighted_sample(df: DataFrame, keys: list[str], weight: str, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """n rows of each group without replacement, by weight (exponential keys)."""
    u = F.greatest(uniform(seed, F.col(id_col)), F.lit(1e-300))
    w = Window.partitionBy(*keys).orderBy(F.asc("_k"), id_col)
    return df.where(F.col(weight) > 0).withColumn("_k", -F.ln(u) / F.col(weight)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_k", "_r")


def kfold_partitions(groups: list, size: int = 3, least_labels: int = 0, labels: dict | None = None) -> list[list[tuple]]:
    """All partitions of a short list into groups of ``size``; the first free element opens each group."""
    from itertools import combinations

    def parts(left: tuple) -> Iterator[list[tuple]]:
        if not left:
            yield []
            return
        for rest in combinations(left[1:], size - 1):
            group = (left[0], *rest)
            for more in parts(tuple(x for x in left if x not in group)):
                yield [group, *more]

    count = lambda p: sum(len(set().union(*(labels[x] for x in g))) for g in p)
    return [p for p in parts(tuple(groups)) if labels is None or count(p) >= least_labels]
