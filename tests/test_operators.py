"""Operators on small tables with hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumaquery import dialect
from lumaquery.functions import arrays as V
from lumaquery.functions.labels import LabelMapping, remap, sort_labels
from lumaquery.operators import aggregates as A
from lumaquery.operators import bootstrap as B
from lumaquery.operators import cells as R
from lumaquery.operators import checks as C
from lumaquery.operators import composites as Q
from lumaquery.operators import joins as J
from lumaquery.operators import metrics as M
from lumaquery.operators import timeline as L


@pytest.fixture(scope="module")
def images(spark):
    rows = [
        (0, 10, 100, [0, 1], [0.5, 0.3], [1, 1], 0, 0, 0), (0, 10, 101, [0, 1], [0.1, 0.2], [1, 1], 0, 0, 0), (0, 10, 102, [0], [0.3], [1], 0, 0, 0), (0, 10, 103, [1], [0.2], [0], 0, 1, 0),
        (0, 20, 201, [0], [0.3], [1], 0, 0, 0), (1, 30, 301, [1], [0.5], [0], 1, 1, 1), (1, 30, 302, [0], [0.8], [1], 1, 1, 1),
    ]
    return spark.createDataFrame(rows, "camera_index int, subject_name int, image_name int, used_labels array<int>, dice_metric array<double>, other_metric array<int>, dataset_index int, epoch_index int, best_epoch_index int")


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_hierarchical_means(images):
    plain = images.drop("dataset_index", "epoch_index", "best_epoch_index")
    score = lambda mode: A.checkpoint_score(plain, "dice_metric", "camera_index", mode=mode).first()[0]
    assert math.isclose(score("class_level"), 0.458333, abs_tol=1e-6)
    assert math.isclose(score("image_level"), 0.404167, abs_tol=1e-6)
    by_image = A.grouped_metrics(plain, ["dice_metric"], mode="image_level")
    assert [(k, round(v, 6)) for k, v in rows(by_image, "subject_name")] == [(10, 0.2625), (20, 0.3), (30, 0.65)]
    kept = A.grouped_metrics(plain, ["dice_metric"], keep_subjects=True)
    assert [(s, k, round(v, 6)) for s, k, v in rows(kept, "used_labels", "subject_name")] == [(10, 0, 0.3), (20, 0, 0.3), (30, 0, 0.8), (10, 1, 0.233333), (30, 1, 0.5)]
    best = A.grouped_metrics(images, ["dice_metric"])
    assert [(k, round(v, 6)) for k, v in rows(best, "used_labels")] == [(0, 0.3), (1, 0.25)]


def test_matrix_sum_and_accuracy(spark):
    m = spark.createDataFrame([(0, [[1, 2], [3, 4]]), (0, [[0, 1], [0, 1]]), (1, [[1, 0], [0, 1]])], "s int, m array<array<bigint>>")
    assert rows(A.matrix_sum(m, ["s"], "m"), "s") == [(0, [[1, 3], [3, 5]]), (1, [[1, 0], [0, 1]])]
    d = spark.createDataFrame([(1, "a", 0, 0), (1, "a", 0, 0), (1, "b", 0, 1)], "subject_name int, image_name string, t int, p int")
    assert A.domain_accuracy(d, "t", "p").first().accuracy == 0.5
    with pytest.raises(PySparkException):
        A.domain_accuracy(d.unionAll(spark.createDataFrame([(1, "a", 0, 1)], d.schema)), "t", "p").collect()


def test_nan_and_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), (None, 9.0)], "k string, x double")
    assert rows(A.means(df, ["x"], ["k"]), "k") == [("a", 2.0)]
    arrays = spark.createDataFrame([(1, [], []), (2, [5], [0.5])], "k int, a array<int>, b array<double>")
    assert rows(A.explode_parallel(arrays, ["a", "b"], ["k"]), "k") == [(1, None, None), (2, 5, 0.5)]
    with pytest.raises(PySparkException):
        A.explode_parallel(spark.createDataFrame([(1, [1, 2], [0.5])], arrays.schema), ["a", "b"], ["k"]).collect()


def test_confusion_and_dice(spark):
    pairs = list(zip([0, 0, 1, 0, 0, 1, 1, 0], [1, 1, 1, 0, 0, 1, 0, 0], strict=True))
    counts = M.confusion(spark.createDataFrame(pairs, "label int, prediction int"), [], 2)
    assert [n for _, _, n in rows(counts, "i", "j")] == [3, 2, 1, 2]
    assert math.isclose(M.dice_from_confusion(counts, []).agg(F.avg("dice")).first()[0], 0.619048, abs_tol=1e-6)
    seven = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 0), (1, 1, 4)], "i int, j int, n bigint")
    assert M.samples_from_confusion(seven, []).count() == 7
    two = spark.createDataFrame([("a", 0, 0, 15), ("a", 0, 1, 5), ("a", 1, 0, 1), ("a", 1, 1, 9), ("b", 0, 0, 8), ("b", 0, 1, 2), ("b", 1, 0, 3), ("b", 1, 1, 5)], "g string, i int, j int, n bigint")
    out = rows(M.normalised_confusion(two, "g"), "i", "j")
    assert np.allclose([r[2] for r in out], [0.775, 0.225, 0.2375, 0.7625]) and np.allclose([r[3] for r in out], [0.025, 0.025, 0.1375, 0.1375])


def test_calibration(spark):
    df = spark.createDataFrame([(1.0, 1, 0), (0.999877, 0, 1), (0.50025, 1, 1), (0.689974, 1, 1)], "c double, p int, y int")
    # the first sample is predicted 1 and labelled 0
    out = {r.bin: r for r in M.calibration_bins(df, [], 3, "c", F.col("p") == F.col("y")).collect()}
    assert {b: r.n for b, r in out.items()} == {1: 1, 2: 3}
    edges = spark.createDataFrame([(1 / 3,), (2 / 3,), (0.34,)], "c double")
    assert [r[0] for r in edges.select(M.bin_right_closed(F.col("c"), 3)).collect()] == [0, 1, 1]
    p = spark.createDataFrame([([0.0, 1.0], 1), ([0.9, 0.1], 0), ([1.0, 0.0], 1), ([0.2, 0.5, 0.3], 2)], "p array<double>, y int")
    assert np.allclose([r[0] for r in p.select(M.brier(F.col("p"), F.col("y"))).collect()], [0, 0.01, 1, 0.04 + 0.25 + 0.49])


def test_thresholds(spark):
    cells = spark.createDataFrame([(0, 0, 0.7, True), (1, 1, 0.7, True), (1, 0, 0.6, True), (1, 1, 0.8, True)], "label int, prediction int, confidence double, valid boolean")
    out = {(t, y): (a, d) for t, y, a, d in rows(M.dice_at_thresholds(cells, [], [0.6, 0.8, 0.9]), "threshold", "label")}
    assert out[0.6, 1] == (1.0, 0.8) and out[0.8, 1] == (1 / 3, 1.0) and out[0.8, 0][0] == 0 and math.isnan(out[0.9, 1][1])


def test_surface(spark):
    cells = [("i", r, c, int(10 <= r < 20), int(13 <= r < 23), True) for r in range(30) for c in range(10)]
    df = spark.createDataFrame(cells, "image_name string, row int, col int, label int, prediction int, valid boolean")
    got = {r.label: r.nsd for r in M.surface_scores(df, tolerance=3.0).collect()}
    assert got[1] == 1.0 and {r.label: r.nsd for r in M.surface_scores(df, tolerance=0.0).collect()}[1] < 1


def test_vectors(spark):
    v = spark.createDataFrame([([1.0, -3.0, 0.0],), ([0.0, 0.0],), ([1.0, 4.0, 9.0, 16.0],)], "v array<double>")
    one = lambda c: [r[0] for r in v.select(c).collect()]
    assert one(V.normalised(F.col("v"))) == [[0.25, -0.75, 0.0], [0.0, 0.0], [x / 30 for x in (1, 4, 9, 16)]]
    assert one(V.gradient(F.col("v")))[2] == [3.0, 4.0, 6.0, 7.0]
    assert np.allclose(one(V.stretched(F.col("v"), 7))[2], np.interp(np.linspace(0, 3, 7), range(4), [1, 4, 9, 16]))
    assert np.allclose(one(V.standard_normal_variate(F.col("v")))[2], (np.array([1, 4, 9, 16]) - 7.5) / np.std([1, 4, 9, 16], ddof=1))
    assert one(V.argmax(F.col("v"))) == [0, 0, 3] and one(V.padded(F.col("v"), 4, 9.0))[1] == [0.0, 0.0, 9.0, 9.0]
    assert np.allclose(one(V.affine(F.slice("v", 1, 2), [[1, 2], [3, 4]], [10, 20]))[2], [23, 38])
    nan = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, float("nan")]), (1, [5.0, 7.0])], "k int, v array<double>")
    assert rows(V.elementwise(nan, ["k"], "v", skip_nan=True), "k") == [(0, [1.0, 2.0]), (1, [5.0, 7.0])]
    assert rows(V.elementwise(nan, ["k"], "v", "std"), "k")[1] == (1, [0.0, 0.0])


def test_mapping(spark):
    m = LabelMapping({"a": 0, "b": 1, "a_second_name": 0, "ignored": 2}, 1)
    df = spark.createDataFrame([("a",), ("a_second_name",), ("ignored",), ("x",)], "n string")
    index = m.index(F.col("n"))
    assert [tuple(r) for r in df.select(index, m.name(index), m.is_valid(index)).collect()] == [(0, "a", True), (0, "a", True), (2, "ignored", False), (None, "unknown", None)]
    assert m.appended("c").names == {"a": 0, "b": 1, "a_second_name": 0, "ignored": 3, "c": 2} and m.renamed("b", "z").names["z"] == 1
    assert [r[0] for r in spark.createDataFrame([(1,), (2,), (3,)], "x int").select(remap(F.col("x"), {1: 10})).collect()] == [10, 2, 3]
    with pytest.raises(PySparkException):
        df.select(LabelMapping(m.names, 1, unknown="error").index(F.col("n"))).collect()
    names = spark.createDataFrame([("unknown_organ", "i1"), ("colon", "i2"), ("stomach", "i4"), ("stomach", "i3"), ("another", "i1")], "label_name string, image_name string")
    assert [tuple(r) for r in sort_labels(names, ["stomach", "colon"]).collect()] == [("stomach", "i3"), ("stomach", "i4"), ("colon", "i2"), ("another", "i1"), ("unknown_organ", "i1")]


def test_class_weights(spark):
    out = rows(A.class_weights(spark.createDataFrame([(0, 10), (1, 5)], "label_index int, n bigint")), "label_index")
    got = {k: [r[i] for r in out] for i, k in enumerate(("label_index", "n", "one", "share", "inverse", "softmin", "nll"))}
    assert got["one"] == [1.0, 1.0] and np.allclose(got["softmin"], [0.339244, 0.660756], atol=1e-6)
    assert np.allclose(got["share"], [1 / 3, 2 / 3]) and np.allclose(got["inverse"], [1 / 3, 2 / 3]) and np.allclose(got["nll"], [0.405465, 1.098612])


def test_ranking(spark):
    values = {"A1": (0.6, 0.8, 0.8), "A2": (0.5, 0.82, 0.7)}
    df = spark.createDataFrame([("T", a, f"C{i}", x) for a, v in values.items() for i, x in enumerate(v)], "task string, algorithm string, case string, value double")
    ranked = B.ranking(df, "task", "algorithm", "case", "value", 200)
    n = {(r.algorithm, r["rank"]): r.n for r in B.rank_counts(ranked, "task", "algorithm").collect()}
    assert n["A1", 1] > n.get(("A1", 2), 0) and n["A1", 1] == n.get(("A2", 2), 0)
    for bad in (df.unionAll(df.limit(1)), df.where("not (algorithm = 'A2' and case = 'C1')"), df.where("algorithm = 'A1'")):
        with pytest.raises(PySparkException):
            B.ranking(bad, "task", "algorithm", "case", "value", 5).collect()


def test_hierarchical_bootstrap(spark):
    pool = [("A", 0, 0)] + [("B", s, 100 * s + i) for s in range(1, 11) for i in range(10)]
    df = spark.createDataFrame(pool, "domain string, subject int, image int")
    out = B.hierarchical(df, "domain", "subject", "image", 100, 10, 10)
    counts = {r.image: r.n for r in out.groupBy("image").agg(F.count("*").alias("n")).collect()}
    assert out.count() == 100 * 200 and counts[0] == 100 * 100
    assert all(40 < n < 180 for i, n in counts.items() if i)


def test_partitions():
    parts = B.kfold_partitions([1, 2, 3, 4, 5, 6], 3)
    assert len(parts) == 10 and parts[0] == [(1, 2, 3), (4, 5, 6)] and parts[-1][0] == (1, 5, 6)


def test_joins(spark):
    a = spark.createDataFrame([(1, 5.0), (1, 12.0), (2, 1.0)], "k int, t double")
    b = spark.createDataFrame([(1, 4.0, "x"), (1, 6.0, "y"), (1, 20.0, "z")], "k int, r double, name string")
    assert rows(J.nearest(a, b, "t", "r", ["k"], ["name"]), "k", "t") == [(1, 5.0, "x"), (1, 12.0, "y"), (2, 1.0, None)]
    spans = spark.createDataFrame([(0.0, 5.0, "p"), (5.0, 11.0, "q")], "a double, b double, s string")
    assert [(r.t, r.s) for r in J.within(a, spans, "t", "a", "b", 4.0).orderBy("t", "s").collect()] == [(1.0, "p"), (5.0, "p"), (5.0, "q")]
    x = spark.createDataFrame([(1, None), (None, 2)], "k int, v int")
    y = spark.createDataFrame([(1, 7), (None, None)], "k int, v int")
    assert {tuple(r) for r in J.natural_left(x, y.withColumnRenamed("v", "w")).collect()} == {(1, None, 7), (None, 2, None)}
    assert {tuple(r) for r in J.update(x.where("k = 1"), y, ["k"]).collect()} == {(1, 7)}
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id long, v array<double>")
    assert rows(J.least_distance(points, points.where("id < 2"), "id", "v", block=1), "id") == [(0, 0.0), (1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)]


def test_timeline(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 3, 7.0), (1, 4, None)], "k int, t int, x double")
    assert [r.x for r in L.interpolated(df, ["k"], "t", "x").orderBy("t").collect()] == [1.0, 3.0, 7.0, 7.0]
    five = spark.createDataFrame([(i, float(i)) for i in range(6)], "t int, x double").withColumn("k", F.lit(1))
    assert [r.moving for r in L.moving_average(five, ["k"], ["t"], "x").orderBy("t").collect()] == [2.0, 3.0]
    assert L.percentile_row(five, ["k"], ["t"], 0.25).first().t == 2  # round(1.5) = 2


def test_cells(spark):
    grid = spark.createDataFrame([(i, r, c, (r + c) % 3, float(r)) for i in (1, 2) for r in range(6) for c in range(6)], "image int, row int, col int, label int, value double")
    assert sorted(map(tuple, R.untiled(R.tiles(grid, 4, 5), 4, 5, 6, 6).select(*grid.columns).collect())) == sorted(map(tuple, grid.collect()))
    shuffled = R.jigsaw(grid, "image", 3, 3)
    assert shuffled.select("image", "row", "col").distinct().count() == 72 and sorted(r.value for r in shuffled.collect()) == sorted(r.value for r in grid.collect())
    assert R.blank(grid, F.col("label") == 2).where("label = 100 and value = 0").count() == 24
    moved = R.transplant(grid, "image", F.col("label") < 2)
    assert moved.count() == 72
    cube = spark.createDataFrame([(1, [1.0, 2.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "image int, s array<double>")
    assert rows(R.cube_validity(cube, "image", "s"), "image") == [(1, True), (2, False)]
    assert rows(R.cube_validity(cube, "image", "s", strict=True), "image") == [(1, False), (2, False)]


def test_checks(spark):
    spec = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train"), ("c", "test")], "image_name string, split_name string")
    images = spark.createDataFrame([("a",), ("b",)], "image_name string")
    assert {r.split_name for r in C.split_of(images, spec, ["image_name"]).collect()} == {"train", "test"}
    with pytest.raises(PySparkException):
        C.split_of(spark.createDataFrame([("c",)], "image_name string"), spec, ["image_name"]).collect()
    with pytest.raises(PySparkException):
        C.enforce(C.repeated_keys(spec, ["image_name"])).collect()


def test_composites(spark):
    df = spark.createDataFrame([("a", [3.0, float("nan")]), ("b", [1.0, 2.0])], "k string, v array<double>")
    out = dict(map(tuple, df.select("k", Q.repaired_softmax(F.col("v"))).collect()))
    assert np.isclose(sum(out["a"]), 1) and out["b"] == [1.0, 2.0]
    c = spark.createDataFrame([("i", [1, 2], {0.5: ([0.9, 0.8], [1.0, 0.7])})], "image string, used_labels array<int>, c map<double, struct<areas: array<double>, dice_metric: array<double>>>")
    assert len(Q.confidences_table(c, ["image"], "c").collect()) == 2


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT STD(x) AS v FROM df", 0.5), ("SELECT 1 / 2 AS v FROM df LIMIT 1", 0), ("SELECT i / 2 AS v FROM df WHERE i = 3", 1), ("SELECT COUNT(*) AS v FROM df WHERE b = 0", 1),
        ("SELECT CAST('0.1' AS FLOAT) AS v FROM df LIMIT 1", 0.1), ("SELECT MEDIAN(x) AS v FROM df", 1.5), ("SELECT QUANTILE(x, 'q=0.25') AS v FROM df", 1.25), ("SELECT GROUP_CONCAT(s) AS v FROM df", "p,q"),
        ("SELECT GROUP_CONCAT(DISTINCT s, ';') AS v FROM df", "p;q"), ("SELECT COUNT(*) AS v FROM (SELECT i, COUNT(*) AS n FROM df GROUP BY i HAVING n = 1 AND s = 'q')", 1), ("SELECT sha1('abc') AS v FROM df LIMIT 1", "a9993e364706816aba3e25717850c26c9cd0d89d"),
        ("SELECT 'FROM nowhere' AS v -- FROM nowhere\nFROM df LIMIT 1", "FROM nowhere"), ("SELECT AVG(x) AS v FROM df", 1.5),
    ],
)
def test_dialect(spark, query, want):
    df = spark.createDataFrame([(1.0, 2, True, "p"), (2.0, 3, False, "q")], "x double, i int, b boolean, s string")
    assert dialect.table_names(query) == ["df"] or "(" in query
    assert dialect.sql(query, {"df": df}).first().v == want


def test_ranked_scores(spark):
    """Area and average precision against pairs counted one by one; odd scores and groups included."""
    scores = [0.1, 0.4, 0.4, 0.4005, 0.8, 0.8, 2.5, -1.0, float("inf"), float("nan")]
    labels = [0, 0, 1, 1, 1, 0, 1, 0, 1, 0]
    rows = [(g, s, y) for g in ("a", None) for s, y in zip(scores, labels, strict=True)] + [("none", 0.5, 0)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    order = [1e9 if s != s else min(s, 1e8) for s in scores]  # NaN is the largest
    pairs = [(a > b) + (a == b) / 2 for a, y in zip(order, labels, strict=True) if y for b, z in zip(order, labels, strict=True) if not z]
    above = lambda s: [y for o, y in zip(order, labels, strict=True) if o >= s]
    precision = [sum(above(s)) / len(above(s)) for s, y in zip(order, labels, strict=True) if y]
    area = {r["g"]: r["auc"] for r in M.auroc(df, ["g"], "s", "y").collect()}
    mean = {r["g"]: r["average_precision"] for r in M.average_precision(df, ["g"], "s", "y").collect()}
    for g in ("a", None):
        assert area[g] == pytest.approx(sum(pairs) / len(pairs))
        assert mean[g] == pytest.approx(sum(precision) / len(precision))
    assert area["none"] is None and mean["none"] is None
    assert M.auroc(df.where("g = 'a'"), [], "s", "y").first()["auc"] == pytest.approx(area["a"])
