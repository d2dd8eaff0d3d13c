"""Best locations, recursive elimination, vector fills and cohort checks with odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from lumaquery.operators import cells, cohorts, elimination
from lumaquery.sources import files


def test_best_location(spark, tmp_path):
    for d in ("dir1", "dir2", "dir2_more"):
        (tmp_path / d).mkdir()
    one, two, more = (str(tmp_path / d) for d in ("dir1", "dir2", "dir2_more"))
    (tmp_path / "dir2" / "file.txt").write_text("x")
    best = lambda *a, **k: files.best_location(spark, *a, **k)
    assert best([one, two]) == one and best([f"{one}/file.txt", f"{two}/file.txt"]) == f"{two}/file.txt"
    assert best([one, two], "dir2") == two and best([one, two], "other") == one
    assert best([f"{one}/file.txt", f"{two}/file.txt"], "dir1") == f"{two}/file.txt"
    assert best([f"{one}/file.txt", f"{two}/file.txt"], "dir1", writing=True) == f"{one}/file.txt"
    assert best([f"{one}/dir2", f"{two}/dir2"], "dir2") == f"{two}/dir2"  # nothing exists: the match, not the shared last name
    assert best([more, two], "dir2") == two  # more alike
    assert best([f"{one}/no", f"{two}/no"]) == f"{one}/no"


def test_recursive_elimination_equals_a_loop(spark):
    r = random.Random(1)
    rows = []
    for i in range(240):
        y = i % 2
        rows.append((y, i % 3, y + r.gauss(0, 0.3), y + r.gauss(0, 1.5), r.gauss(0, 1), r.gauss(0, 1)))
    df = spark.createDataFrame(rows, "y int, fold int, strong double, weak double, none1 double, none2 double")
    names = ["strong", "weak", "none1", "none2"]
    got = [(x.round, x.feature) for x in elimination.recursive_elimination(df, "y", names, "fold", trees=5, depth=3).orderBy("round").collect()]
    left, want = sorted(names), []
    while len(left) > 1:
        found = elimination.importances(df, "y", left, "fold", 5, 3)
        assert sum(found.values()) == pytest.approx(1)
        want.append((len(want), min(left, key=lambda f: (found[f], f))))
        left.remove(want[-1][1])
    assert got == [*want, (3, left[0])] and left == ["strong"]


def test_fills_of_odd_cells(spark):
    rows = [("a", 0, 0, 1, [1.0, 2.0]), ("a", 0, 1, 2, [3.0, 4.0]), ("b", 0, 0, None, None), ("b", 1, 0, 1, [])]
    df = spark.createDataFrame(rows, "image string, row int, col int, label int, value array<double>")
    key = lambda d: sorted(((r.image, r.row, r.col, r.label, r.value) for r in d.collect()), key=str)
    assert key(cells.fill_vectors(df, "image", F.col("label") == 1)) == sorted([("a", 0, 0, 100, [0.0, 0.0]), ("a", 0, 1, 2, [3.0, 4.0]), ("b", 0, 0, None, None), ("b", 1, 0, 100, [])], key=str)
    assert key(cells.fill_vectors(df, "image", F.col("label") == 1, p=0.0)) == sorted(map(tuple, rows), key=str)
    filled = {(r.image, r.row, r.col): r.value for r in cells.fill_vectors(df, "image", F.lit(True), "random").collect()}
    assert sum(filled["a", 0, 0]) == pytest.approx(1) and filled["a", 0, 0] != filled["a", 0, 1] and filled["b", 0, 0] is None
    donor = spark.createDataFrame([(0, 1, [9.0, 8.0])], "row int, col int, value array<double>")
    assert {r.col: r.value for r in cells.fill_vectors(df.where("image = 'a'"), "image", F.lit(True), "donor", donor=donor).collect()} == {0: [0.0, 0.0], 1: [9.0, 8.0]}
    with pytest.raises(ValueError, match="no way"):
        cells.fill_vectors(df, "image", F.lit(True), "other")


def test_cohorts_with_nulls(spark):
    df = spark.createDataFrame([(1, "a|x.y", "s", "pig"), (2, "axxy", None, "rat"), (3, None, "s", None), (4, "x.y", None, "pig")], "id int, tags string, situs string, species string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(cohorts.tagged(df, "tags", "x.y")) == [1, 4] and ids(cohorts.tagged(df, "tags", "x.y", ["situs"])) == [1]
    assert ids(cohorts.by_part(df, "species", {"pig": F.col("situs") == "s", "rat": F.lit(True)})) == [1, 2] and ids(cohorts.by_part(df, "species", {})) == []
    dosed = spark.createDataFrame([(1, [700.0, 30.0]), (2, []), (3, None), (4, [601.0])], "id int, s array<double>")
    got = {r.id: (r.last_injection, r.series, r.clear, r.perfusion_state) for r in cohorts.dosed(dosed, "s").collect()}
    assert got == {1: (30.0, 2, True, "icg"), 2: (None, None, False, "physiological"), 3: (None, None, False, "physiological"), 4: (601.0, 1, False, "icg")}
    spec = spark.createDataFrame([("f", "train", "i"), ("f", "val", "i"), ("f", "test", "j"), ("f", "train", "j"), ("g", "train", "i")], "fold_name string, split_name string, image_name string")
    shared = lambda **k: sorted(r.key for r in cohorts.shared_between_splits(spec, "image_name", **k).collect())
    assert shared() == ["f#i", "f#j"] and shared(may=("test",)) == ["f#i"]
    assert sorted(r.key for r in cohorts.empty_splits(spec, ["train", "val"]).collect()) == ["g#val"]
