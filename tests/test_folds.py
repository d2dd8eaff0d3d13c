"""Stratified group folds, fold enumeration and distance correlation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaquery.operators import checks, dependence, folds, joins

RNG = np.random.default_rng(5)


def table(spark, rows):
    return spark.createDataFrame(rows, "subject string, label string")


TABLES = {
    "even": [(f"s{i}", "ab"[i % 2]) for i in range(20)],
    "rare": [(f"s{i}", "a") for i in range(30)] + [(f"s{i}", "rare") for i in (3, 4, 9)],
    "sizes": [(f"s{i}", "abc"[(i * 7 + j) % 3]) for i in range(23) for j in range(int(RNG.integers(1, 30)))],
    "one large": [("big", "a")] * 100 + [(f"s{i}", "ab"[i % 2]) for i in range(40)] + [("n", None), ("n", "a")],
    "few": [("x", "a"), ("y", "a")],
}


def plain_folds(rows, k):
    labels = sorted({label for _, label in rows}, key=lambda x: (x is None, str(x)))
    total = {x: sum(r[1] == x for r in rows) for x in labels}
    weight = {x: 10**18 // total[x] ** 2 for x in labels}
    counts = {s: {x: sum(r == (s, x) for r in rows) for x in labels} for s in {r[0] for r in rows}}
    order = sorted(counts, key=lambda s: (-sum(n * n * weight[x] for x, n in counts[s].items()), s))
    held, out = [dict.fromkeys(labels, 0) for _ in range(k)], {}
    for s in order:
        cost = [(sum(held[f][x] * n * weight[x] for x, n in counts[s].items()), sum(held[f].values()), f) for f in range(k)]
        f = out[s] = min(cost)[2]
        for x, n in counts[s].items():
            held[f][x] += n
    return out


@pytest.mark.parametrize("name", sorted(TABLES))
def test_group_folds(spark, name):
    rows, k = TABLES[name], 4
    df = table(spark, rows)
    got = folds.group_folds(df, "subject", "label", k)
    out = [(r.subject, r.fold) for r in got.collect()]
    assert dict(out) == plain_folds(rows, k) and len(out) == len(dict(out)) == len({r[0] for r in rows})
    dealt = checks.stratified_folds(df, "subject", "label", k)
    spread = lambda f: folds.unevenness(df, f, "subject", "label", k).first().spread
    assert spread(got) <= spread(dealt) + 1e-12


def test_group_folds_in_lots_and_keys(spark):
    rows = [("u" if i % 2 else "v", f"s{i}", "abc"[int(RNG.integers(3))]) for i in range(200) for _ in range(3)]
    df = spark.createDataFrame(rows, "t string, subject string, label string")
    one = folds.group_folds(df, "subject", "label", 3, ["t"])
    for t in "uv":
        assert {r.subject: r.fold for r in one.where(F.col("t") == t).collect()} == plain_folds([r[1:] for r in rows if r[0] == t], 3)
    lots = folds.group_folds(df, "subject", "label", 3, lot=20)
    assert lots.count() == 200 == lots.select("subject").distinct().count()
    assert folds.unevenness(df, lots, "subject", "label", 3).first().spread < 0.02
    assert folds.group_folds(df.where("false"), "subject", "label", 3).collect() == []


def test_nested_group_folds(spark):
    df = table(spark, TABLES["sizes"])
    out = folds.nested_group_folds(df, "subject", "label", 3, 2).collect()
    by = {}
    for r in out:
        by.setdefault((r.outer_fold, r.fold), {})[r.subject] = r.split
    assert len(by) == 6 and all(len(v) == 23 for v in by.values())
    test = {o: {s for s, x in by[o, 0].items() if x == "test"} for o in range(3)}
    assert set.union(*test.values()) == {r[0] for r in TABLES["sizes"]} and sum(map(len, test.values())) == 23
    for o in range(3):
        val = [{s for s, x in by[o, f].items() if x == "val"} for f in range(2)]
        assert not val[0] & val[1] and val[0] | val[1] | test[o] == {r[0] for r in TABLES["sizes"]}


def test_fold_partitions(spark):
    make = lambda rows: spark.createDataFrame(rows, "s int, l array<int>")
    six = make([(i, [0, 1, 2]) for i in range(6)])
    # fixed values: all ways for six subjects in groups of three
    want = [
        [0, 1, 2, 3, 4, 5], [0, 1, 3, 2, 4, 5], [0, 1, 4, 2, 3, 5], [0, 1, 5, 2, 3, 4], [0, 2, 3, 1, 4, 5], [0, 2, 4, 1, 3, 5],
        [0, 2, 5, 1, 3, 4], [0, 3, 4, 1, 2, 5], [0, 3, 5, 1, 2, 4], [0, 4, 5, 1, 2, 3],
    ]
    got = folds.fold_partitions(six, "s", "l").collect()
    assert sorted(sum(r.groups, []) for r in got) == want and {r.n_labels for r in got} == {6}
    assert folds.fold_partitions(six, "s", "l", least=7).collect() == []
    nine = make([(i, [i % 4] if i else None) for i in range(9)])
    rows = folds.fold_partitions(nine, "s", "l").collect()
    assert len(rows) == 280
    assert all(r.n_labels == sum(len({x % 4 for x in g if x}) for g in r.groups) for r in rows)
    assert folds.fold_partitions(nine, "s", "l", least=8).count() == sum(r.n_labels >= 8 for r in rows)
    assert folds.fold_partitions(make([(i, [1]) for i in range(8)]), "s", "l", size=2).count() == 105
    assert folds.fold_partitions(make([(i, [1]) for i in range(8)]), "s", "l").collect() == [] == folds.fold_partitions(six.where("false"), "s", "l").collect()


def dcor(x, y):
    d = [np.sqrt(((np.asarray(v, float)[:, None, :] - np.asarray(v, float)[None, :, :]) ** 2).sum(2)) for v in (x, y)]
    d = [a - a.mean(0) - a.mean(1)[:, None] + a.mean() for a in d]
    whole = np.sqrt((d[0] ** 2).mean() * (d[1] ** 2).mean())
    return np.sqrt(max(0, (d[0] * d[1]).mean()) / whole) if whole > 1e-12 else 0.0


def test_sums_of_smaller_ones():
    first, second = RNG.integers(0, 6, 80), RNG.integers(0, 9, 80).astype(float)
    values = RNG.normal(size=(80, 2))
    before = lambda i, j: first[i] < first[j] and (second[i] < second[j] or second[i] == second[j] and i < j)
    want = [sum((values[i] for i in range(80) if before(i, j)), np.zeros(2)) for j in range(80)]
    assert np.allclose(dependence.smaller_sums(first, second, values), want)


@pytest.mark.parametrize("block", [13, 60, 10_000])
def test_distance_correlation_of_numbers(spark, block):
    rows = []
    for g, n in ((None, 150), ("ties", 200), ("flat", 9), ("one", 1)):
        x = RNG.normal(size=n) * 100 if g != "flat" else np.ones(n)
        if g == "ties":
            x = np.where(np.arange(n) % 3 == 0, 1.0, RNG.integers(0, 5, n))
        y = np.round(x**2 / 50 + RNG.normal(size=n), 1)
        rows += [(g, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (None, 999, None, 1.0), (None, 998, 1.0, None)], "g string, i int, x double, y double")
    got = {r.g: r.dcor for r in dependence.distance_correlation(df, ["g"], "i", "x", "y", block).collect()}
    for g in {r[0] for r in rows}:
        v = np.array([r[2:] for r in rows if r[0] == g])
        assert got[g] == pytest.approx(dcor(v[:, :1], v[:, 1:]), abs=1e-7)
    every = dependence.distance_correlation(df, [], "i", "x", "y", block).first().dcor
    v = np.array([r[2:] for r in rows])
    assert every == pytest.approx(dcor(v[:, :1], v[:, 1:]), abs=1e-7)


def test_distance_correlation_of_vectors(spark):
    # fixed values of the published examples
    x = [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0], [9.0, 10.0, 11.0, 12.0], [13.0, 14.0, 15.0, 16.0]]
    df = spark.createDataFrame([(i, v, [y], y) for i, (v, y) in enumerate(zip(x, [1.0, 0.0, 0.0, 1.0], strict=True))], "i int, x array<double>, y array<double>, z double")
    of = lambda d, a, b, block=None: dependence.distance_correlation(d, [], "i", a, b, block).first().dcor
    for block in (1, 3, None):
        assert of(df, "x", "y", block) == pytest.approx(0.52664, abs=1e-5) and of(df, "x", "z", block) == of(df, "x", "y", block)
    assert of(df, "x", "x") == pytest.approx(1) and of(df, "z", "z") == pytest.approx(1)
    hot = spark.createDataFrame([(0, [1.0, 10.0], [0, 1], [0, 0, 1]), (1, [1.0, 8.0], [1, 0], [1, 0, 0]), (2, [3.0, 9.0], [1, 0], [1, 0, 0])], "i int, x array<double>, y array<int>, z array<int>")
    assert of(hot, "x", "y") == pytest.approx(of(hot, "x", "z"))
    numbers = spark.createDataFrame(list(enumerate(zip([1.0, 2.0, 3.0, 4.0, 4.0], [1.0, 2.2, -3.3, 2.0, 2.0], strict=True))), "i int, p struct<x: double, y: double>").select("i", "p.*")
    assert of(numbers, "x", "y") == pytest.approx(0.5242320806029278)


@pytest.mark.parametrize("block", [7, 40, 20_000])
def test_least_distance_by_tiles(spark, block):
    unit = RNG.normal(size=(60, 4))
    unit /= np.sqrt((unit**2).sum(1))[:, None]  # equal norms, up to rounding
    ones = np.sign(RNG.normal(size=(30, 4)))  # equal norms
    x, y = np.vstack([RNG.normal(size=(80, 4)) * 5, unit[:30], ones[:15]]), np.vstack([RNG.normal(size=(70, 4)) * 3, unit[30:], ones[10:]])
    tests = [(f"t{i}", [float(a) for a in v]) for i, v in enumerate(x)] + [("none", None), (None, [0.0] * 4), ("t0", [float(a) for a in y[3]])]
    df = lambda rows: spark.createDataFrame(rows, "k string, v array<double>")
    training = df([("x", [float(a) for a in v]) for v in y] * 2 + [("x", None)])
    got = {r.k: r.min_distance for r in joins.least_distance(df(tests), training, "k", "v", block).collect()}
    want = {f"t{i}": np.sqrt(((y - v) ** 2).sum(1)).min() for i, v in enumerate(x)} | {"t0": 0.0, None: np.sqrt((y**2).sum(1)).min()}
    assert got.pop("none") is None and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    empty = joins.least_distance(df(tests), training.where("false"), "k", "v").collect()
    assert len(empty) == len(got) + 1 and all(r.min_distance is None for r in empty)


def test_group_folds_of_many_subjects_follow_one_order(spark):
    """Lots matched to each other gave other folds than the one greedy order."""
    counts = RNG.integers(0, 4, (200, 3))
    rows = [(f"s{i}", x) for i, own in enumerate(counts) for x, n in zip("abc", own) for _ in range(n)]
    for k in (3, 5):
        got = folds.group_folds(table(spark, rows), "subject", "label", k, lot=20).collect()
        assert {r.subject: r.fold for r in got} == plain_folds(rows, k)
