"""Functions that no registered query shows."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaquery.functions import arrays as V
from lumaquery.functions import keys as K
from lumaquery.operators import aggregates as A
from lumaquery.operators import bootstrap as B
from lumaquery.operators import cells as R
from lumaquery.operators import checks as C
from lumaquery.operators import composites as Q
from lumaquery.operators import joins as J
from lumaquery.operators import metrics as M
from lumaquery.sources import files as S
from lumaquery.sources import tables as T
from lumaquery.streaming import streams as X


def png(pixels: np.ndarray) -> bytes:
    """A plain picture file from (height, width, 3) bytes."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + line.tobytes() for line in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_colour_images(spark, tmp_path):
    pixels = np.arange(6 * 7 * 3, dtype=np.uint8).reshape(6, 7, 3)
    (tmp_path / "i1").mkdir()
    (tmp_path / "i1" / "x_RGB-Image.png").write_bytes(png(pixels))
    out = S.colour_images(spark, str(tmp_path), border=(2, 1, 1, 2), height=3, width=4).collect()
    assert {(r.row, r.col): [r.r, r.g, r.b] for r in out} == {(i, j): pixels[i + 2, j + 2].tolist() for i in range(3) for j in range(4)} and out[0].image_name == "i1"
    with pytest.raises(Exception, match="unexpected size"):
        S.colour_images(spark, str(tmp_path)).collect()


def test_locations_and_metadata(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    (tmp_path / "b" / "t.json").write_text(json.dumps({"k": 1}))
    at = [str(tmp_path / x) for x in ("none", "a", "b")]
    assert S.first_existing(spark, at, "t.json") == at[2] and S.first_existing(spark, at, "other") == at[1]
    with pytest.raises(FileNotFoundError):
        S.first_existing(spark, at[:1], "t.json")
    assert S.json_metadata(spark, at[2]).first().k == 1
    S.write_if_absent(spark.range(2), str(tmp_path / "t"))
    S.write_if_absent(spark.range(5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    for fold in ("f1", "f2"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / "runs" / fold))
    found = T.fold_tables(spark, [str(tmp_path / "runs" / f) for f in ("f1", "f2")])
    assert {(r.fold_name, r.n) for r in found.groupBy("fold_name").agg(F.count("*").alias("n")).collect()} == {("f1", 3), ("f2", 3)}


def test_colours_of_labels(spark):
    colours = spark.createDataFrame([(0, 1, 2, 3), (1, 9, 9, 9)], "label int, r int, g int, b int")
    cells = spark.createDataFrame([(0, 0), (1, 1), (2, 5)], "x int, label int")
    assert [(r.x, r.r) for r in R.colours_of_labels(cells, colours).orderBy("x").collect()] == [(0, 1), (1, 9), (2, 0)]
    pixels = spark.createDataFrame([(9, 9, 9), (0, 0, 0)], "r int, g int, b int")
    assert R.labels_of_colours(pixels.where("r = 9"), colours).first().label == 1
    with pytest.raises(Exception, match="no label for the colour"):
        R.labels_of_colours(pixels, colours).collect()


def test_curves_of_odd_scores(spark):
    df = spark.createDataFrame([(-1.0, 1), (0.5, 1), (0.2, 0), (1.7, 0), (float("nan"), 1), (None, 0)], "s double, y int")
    out = {round(r.threshold, 2): (r.tpr, r.fpr) for r in M.roc(df, [], "s", "y", 11).collect()}
    assert len(out) == 11 and out[0.0] == (0.5, 1.0) and out[0.5] == (0.5, 0.5) and out[1.0] == (0.0, 0.5)
    curve = spark.createDataFrame([("a", 0.1, 0.3), ("a", 0.22, 0.7), ("a", 0.5, 0.9)], "k string, fpr double, tpr double")
    assert Q.rate_at(curve, ["k"]).first().tpr == 0.7


def test_nearest_with_ties_and_gaps(spark):
    left = spark.createDataFrame([("a", float(x)) for x in range(0, 40, 3)] + [("b", 1.0)], "k string, x double")
    right = spark.createDataFrame([("a", 4.0, "p"), ("a", 4.0, "o"), ("a", 10.0, "q"), ("a", 31.0, "r")], "k string, y double, v string")
    got = {(r.k, r.x): r.v for r in J.nearest(left, right, "x", "y", ["k"], ["v"]).collect()}
    points = [(4.0, "o"), (10.0, "q"), (31.0, "r")]
    assert got == {("a", x): min(points, key=lambda p: (abs(p[0] - x), p[0]))[1] for k, x in got if k == "a"} | {("b", 1.0): None}


def test_distance_correlation_by_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=90)
    rows = [(i % 2, i, float(x[i]), float(x[i] ** 2 + 0.1 * rng.normal())) for i in range(90)] + [(2, 100, 1.0, 1.0), (2, 101, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, i int, x double, y double")

    def plain(a, b):
        c = [np.abs(v[:, None] - v[None, :]) for v in (a, b)]
        c = [d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in c]
        return np.sqrt((c[0] * c[1]).mean() / np.sqrt((c[0] ** 2).mean() * (c[1] ** 2).mean()))

    for block in (7, 1000):
        got = {r.g: r.dcor for r in M.distance_correlation(df, ["g"], "i", "x", "y", block).collect()}
        for g in (0, 1):
            v = np.array([r[2:] for r in rows if r[0] == g])
            assert got[g] == pytest.approx(plain(v[:, 0], v[:, 1]), abs=1e-9)
        assert got[2] == 0


def test_evaluate_images(spark):
    rows = [("i", k // 4, k % 4, int(k < 8), int(k < 6), True, 0.8) for k in range(16)] + [("j", 0, 0, 1, 1, True, 0.9), ("j", 0, 1, 0, 1, False, 0.9)]
    cells = spark.createDataFrame(rows, "image string, row int, col int, label int, prediction int, valid boolean, confidence double")
    out = {r.image: r for r in M.evaluate_images(cells, "image", 2, "confidence", tolerance=1.0).collect()}
    assert out["i"].accuracy == 14 / 16 and out["i"].confusion == [[8, 0], [2, 6]] and out["i"].dice[1] == pytest.approx(12 / 14) and out["i"].error == pytest.approx(0.075)
    assert out["j"].accuracy == 1 and out["j"].dice == {1: 1.0} and out["j"].surface_dice == {1: 1.0}
    with pytest.raises(Exception, match="no valid cell"):
        M.evaluate_images(cells.withColumn("valid", F.lit(False)), "image", 2).collect()


def test_numbered_and_shares(spark):
    df = spark.range(3000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("image_name"), (F.col("id") % 3).alias("g"))
    out = B.numbered(df, B.uniform(4, F.col("image_name")), ["image_name"], "k", ["g"]).collect()
    assert all(sorted(r.k for r in out if r.g == g) == list(range(1000)) for g in range(3))
    draws = [r.u for r in df.select(B.uniform(1, F.col("image_name")).alias("u")).collect()]
    assert 0 <= min(draws) and max(draws) < 1 and abs(np.mean(draws) - 0.5) < 0.03
    for strided in (True, False):
        n = [r.n for r in X.worker_share(df, 7, strided).groupBy("worker").agg(F.count("*").alias("n")).collect()]
        assert len(n) == 7 and max(n) - min(n) <= 1
    assert M.batches(df.repartition(3), 50).groupBy("part", "batch").count().agg(F.max("count")).first()[0] == 50


def test_folds(spark):
    df = spark.createDataFrame([(s, "ab"[s % 2]) for s in range(30) for _ in range(1 + s % 3)], "s int, y string")
    rows = C.nested_folds(df, "s", "y", 3, 2).collect()
    for o in range(3):
        tests = {r.s for r in rows if r.outer_fold == o and r.split == "test"}
        vals = [{r.s for r in rows if r.outer_fold == o and r.fold == f and r.split == "val"} for f in range(2)]
        assert len(tests) == 10 and not vals[0] & vals[1] and vals[0] | vals[1] | tests == set(range(30))
    sets = {}
    for r in C.subset_series(df, "s", [2, 29], 5).collect():
        sets.setdefault((r["size"], r.seed), set()).add(r.s)
    assert len(sets) == 10 and all(len(v) == k[0] for k, v in sets.items()) and len({frozenset(v) for v in sets.values()}) == 10
    assert [r.i for r in C.large_enough(df.withColumnRenamed("s", "i"), "i", F.col("y") == "a", 2).orderBy("i").collect()] == [2, 8, 14, 20, 26]
    both = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "i int, y string")
    assert [r.i for r in C.with_all_labels(both, "i", "y", ["a", "b"]).collect()] == [1]


def test_result_tables(spark):
    df = spark.createDataFrame([("fold_n=3_seed=1", "s", "i", [0, 1], [0.5, 0.7]), ("fold_n=9_seed=0", "s", "i", [0], [0.9])], "fold_name string, subject_name string, image_name string, used_labels array<int>, dice array<double>")
    assert {(r["size"], r.seed, r.used_labels): r.dice for r in Q.size_table(df, ["dice"]).collect()} == {(3, 1, 0): 0.5, (3, 1, 1): 0.7, (9, 0, 0): 0.9}
    assert {r.used_labels: r.dice for r in Q.aggregated_table(df, ["dice"]).collect()} == {0: pytest.approx(0.7), 1: 0.7}
    wide = spark.createDataFrame([("a", 1.0, float("nan")), ("b", None, 2.0)], "k string, x double, y double")
    assert {tuple(r) for r in Q.challenge_table(wide, ["k"], ["x", "y"]).collect()} == {("a", "x", 1.0), ("b", "y", 2.0)}
    order = spark.createDataFrame([(0, 1), (1, 0)], "old int, new int")
    cells = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "i int, j int, n int")
    assert {tuple(r) for r in Q.permuted(cells, order).collect()} == {(1, 1, 5), (1, 0, 6)}
    hits = spark.createDataFrame([("s", 1, 1), ("s", 0, 1)], "s string, y int, p int")
    assert Q.subject_accuracy(hits, "s", "y", "p").first().accuracy == 0.5
    distances = spark.createDataFrame([("s", 1.0), ("s", 3.0), ("t", 4.0)], "s string, d double")
    assert tuple(A.reduced_tolerance(distances, "s", "d").first()) == (3.0, 1.0)
    importances = spark.createDataFrame([("f", 0.2), ("g", 0.1), ("g", 0.5)], "f string, v double")
    assert Q.least_important(importances, "f", "v").first().f == "f" and [r.f for r in Q.eliminated(importances, "f", "v", "o").orderBy("o").collect()] == ["f", "g"]


def test_vectors_and_states(spark):
    df = spark.createDataFrame([(0, [1.0, 4.0], "clamp"), (1, [3.0, 0.5], "other")], "i int, v array<double>, phase string")
    assert df.select(V.one_hot(F.col("i"), 3)).first()[0] == [1.0, 0.0, 0.0] and df.select(V.one_hot(F.col("i"), 3, 0.2)).first()[0] == pytest.approx([0.8, 0.1, 0.1])
    assert df.select(V.absorption(F.col("v"))).first()[0] == pytest.approx([0.0, -np.log(4)])
    assert [r[0] for r in df.select(R.oversaturated(F.col("v"), 3.5)).collect()] == [True, False]
    states = Q.perfusion_state(df, "phase", {"clamp": "ischemic"}, clear=F.when(F.col("i") == 1, True)).collect()
    assert [r.perfusion_state for r in states] == ["ischemic", None]
    assert df.select(Q.blended(F.col("v"), [[1.0, 0.0], [0.0, 1.0]], [1.0, 1.0], F.lit(0.5))).first()[0] == [1.5, 4.5]
    assert df.select(Q.in_situ(F.create_map(F.lit("a"), F.col("i") == 0))).first()[0] and spark.range(1).select(K.images_per_epoch(F.lit("501 images"), 20)).first()[0] == 520
    out = Q.repeated_transform(df, lambda d, e: d.withColumn("v", F.transform("v", lambda x: x + e)), 2, [], "v").orderBy("epoch_index").collect()
    assert [r.v for r in out] == [[2.0, 2.25], [3.0, 3.25]]
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(int(k % 2), [float(x) for x in rng.normal(size=3) + 5 * (k % 2)]) for k in range(60)], "y int, v array<double>")
    values, _ = M.discriminant(points, "y", "v")
    assert values[0] > 1 and abs(values[1:]).max() < 1e-6
    first = [r.components[0] for r in Q.principal_components(points, "v", 2).orderBy("y").collect()]
    assert abs(np.mean(first[:30]) - np.mean(first[30:])) > 5
    p = spark.createDataFrame([(1, [0.5, 0.5]), (1, [0.7, 0.3])], "s int, p array<double>")
    assert M.gini(p, ["s"], "p").first().gini == pytest.approx(1 - 0.6**2 - 0.4**2)


def test_borders_and_spectra(spark):
    cells = spark.createDataFrame([("i", r, c, int(c < 2), int(c < 3)) for r in range(4) for c in range(5)], "image_name string, row int, col int, label int, prediction int")
    found = [r.distance for r in M.border_distances(cells).where("label = 1").collect()]
    assert found and max(found) <= 1.0
    df = spark.createDataFrame([("a", [1.0, 2.0], [0.5, float("nan")], "x"), ("a", [3.0, 4.0], [0.5, 0.5], "x")], "k string, v array<double>, d array<double>, c string")
    r = T.group_median_spectra(df, ["k"], ["v"], ["d"], ["c"]).first()
    assert (r.v, r.d, r.c, r.n_spectra) == ([2.0, 3.0], [0.5, 0.5], "x", 2)


def test_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("u", f"2024-01-01 00:{m:02d}:00") for m in (0, 2, 4, 30, 31)], "u string, t string").select("u", F.col("t").cast("timestamp").alias("ts"))
    assert sorted(r.n for r in X.sessions(rows, "ts", "5 minutes", ["u"]).collect()) == [2, 3]


def test_spectrometer_statistics(spark):
    spectra = {"w_1": [2.0, 4.0], "d_1": [0.0, 1.0], "x_1": [1.0, 2.5], "x_2": [2.0, 1.0]}
    rows = [(f, f[0], k, 500.0 + k, v) for f, vs in spectra.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "file string, label string, at int, wavelength double, value double")
    out = {r.at: r for r in S.spectrometer_statistics(df, "w", "d").collect()}
    assert [(out[k].label, out[k].mean, out[k].n) for k in (0, 1)] == [("x", 0.75, 2), ("x", 0.25, 2)] and out[0].std == 0.25
    normed = {(r.label, r.at): r.mean for r in S.spectrometer_statistics(df.where("file = 'x_1'"), norm=1).collect()}
    assert normed == {("x", 0): pytest.approx(1 / 3.5), ("x", 1): pytest.approx(2.5 / 3.5)}


def test_copies_in_folders(spark, tmp_path):
    for side, content in (("a", b"1"), ("b", b"2")):
        for sub in ("x", "y"):
            (tmp_path / side / sub).mkdir(parents=True)
            (tmp_path / side / sub / "same").write_bytes(content if sub == "y" else b"0")
    assert [r.name for r in S.verified_copy(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()] == ["y/same"]


def test_erased_region(spark):
    cells = spark.createDataFrame([("i", k, 0, 1, 1.0, k // 3) for k in range(9)], "image string, row int, col int, label int, value double, region int")
    out = R.erase_region(cells, "image", "region").collect()
    gone = {r.region for r in out if r.label == R.INVALID}
    assert len(gone) == 1 and all((r.value == 0) == (r.region in gone) for r in out)
    assert all(r.label == 1 for r in R.erase_region(cells, "image", "region", p=0.0).collect())


def test_parts_follow_the_rows(spark, sf_dir, monkeypatch):
    """Annotation tables were grouped in as few tasks as the exchange's bytes filled, whatever their rows."""
    from lumaquery import session
    from lumaquery.plans import corpus, details, hierarchy

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    for table in (corpus.stats, hierarchy.images, details._folded):
        assert table(spark, sf_dir).rdd.getNumPartitions() >= 12  # of some 6000 line items


def test_checks_of_many_keys_are_dealt(spark, monkeypatch):
    from lumaquery import session
    from lumaquery.operators import checks

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    df = spark.range(3000).select((F.col("id") % 2990).alias("k"))
    few, other = df.where("k < 2000"), spark.range(1995, 4000).select(F.col("id").alias("k"))
    for found, n in ((checks.repeated_keys(df, ["k"]), 10), (checks.missing_keys(few, other, ["k"]), 1995), (checks.shared_keys({"a": few, "b": other}, ["k"]), 5)):
        assert found.count() == n and found.rdd.getNumPartitions() >= 5


def test_pairs_of_one_label_are_made_by_blocks(spark):
    """All pairs of a label were made in one task."""
    from lumaquery.operators import cells

    rows = spark.range(600).select(F.when(F.col("id") % 100 == 7, None).when(F.col("id") < 500, "a").otherwise("b").alias("l"), (F.col("id") % 3).alias("c"), F.col("id").alias("i"))
    whole = cells.pairs_by_label(rows, "l", F.col("c") == 0, F.col("c") == 1, "i")
    got = cells.pairs_by_label(rows, "l", F.col("c") == 0, F.col("c") == 1, "i", block=20)
    known = [(r.l, r.c, r.i) for r in rows.collect() if r.l]
    want = sorted((a[0], a[2], b[2]) for a in known for b in known if a[0] == b[0] and a[1] == 0 and b[1] == 1)
    assert sorted(map(tuple, got.collect())) == want == sorted(map(tuple, whole.collect()))
    assert max(r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < len(want) / 4


def test_neighbours_need_one_exchange(spark, sf_dir):
    """Moved cells, the join with the cells and their grouping each had an exchange of their own."""
    from lumaquery.plans import reading

    plan = reading.neighbour_matrix(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
