"""Deep merges, metadata, user aggregates, transformations with validity, bootstrapped curves, lightness."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaquery.dialect import sql
from lumaquery.functions import documents
from lumaquery.operators import bootstrap, cells, curves, extensions, metrics


def merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merged(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in sorted({*a, *b})}
    return b


def some(r, depth):
    kind = r.randrange(7 if depth else 4)
    if kind > 3:
        return {k: some(r, depth - 1) for k in r.sample(["a", "b", "B", "x.y", "é", "10", "9"], r.randrange(5))}
    return [r.randrange(9), None, r.choice(["", "t", "ü"]), [1, {"q": r.randrange(3)}]][kind]


def test_deep_merge(spark):
    r = random.Random(2)
    # fixed values: the published example
    pairs = [({"1": {"a": "A"}, "2": {"b": "B", "conflict": "with_b"}}, {"2": {"c": "C", "conflict": "with_c"}, "3": {"d": "D"}})]
    pairs += [({k: some(r, 4) for k in "abc"}, {k: some(r, 4) for k in "bcd"}) for _ in range(60)] + [(1, {"a": 1}), ({"a": 1}, [2]), ({}, {})]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {x.i: x.m for x in df.select("i", documents.merged_text(F.col("a"), F.col("b"), 6).alias("m")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert json.loads(got[i]) == merged(a, b)
    assert got[0] == '{"1":{"a":"A"},"2":{"b":"B","c":"C","conflict":"with_c"},"3":{"d":"D"}}'
    assert df.where("i = 0").select(documents.merged_text(F.col("a"), F.lit(None).cast("string")).alias("m")).first().m == json.dumps(pairs[0][0], separators=(",", ":"))
    with pytest.raises(Exception, match="deepest level"):
        df.where("i = 0").select(documents.merged_text(F.col("a"), F.col("b"), 1)).collect()


def test_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": {"d": "x"}}, "e": [1, 2], "f": {}}'), (2, "3"), (3, None)], "i int, t string").select("i", F.parse_json("t").alias("v"))
    got = sorted((r.i, r.path, r.v) for r in documents.leaves(df, "i", "v", 3).select("i", "path", F.to_json("value").alias("v")).collect())
    assert got == [(1, "a.b", "1"), (1, "a.c.d", '"x"'), (1, "e", "[1,2]"), (2, "", "3")]


def test_metadata_and_camera_names(spark):
    entries = spark.createDataFrame([("i1", "Camera_CamID", "7"), ("i1", "gain", "2"), ("i2", "Camera_CamID", "7"), ("i2", "extra", "e"), ("i3", "gain", "1"), ("i4", "camera_name", "mine"), ("i5", "Camera_CamID", "8")], "image_name string, key string, value string")
    table = documents.metadata_table(entries, "image_name")
    assert table.columns == ["image_name", "Camera_CamID", "camera_name", "extra", "gain"]
    dated = table.withColumn("timestamp", F.when(F.col("image_name") == "i1", "2020_01_01").otherwise("2021_01_01"))
    changes = spark.createDataFrame([("7", "2020_06_01", "wrong-1", "correct-2")], "camera string, change_date string, suffix_before string, suffix_after string")
    got = {r.image_name: (r.Camera_CamID, r.camera_name) for r in documents.camera_names(dated, changes, "timestamp").collect()}
    assert got == {"i1": ("7", "7_wrong-1"), "i2": ("7", "7_correct-2"), "i3": ("unknown", "unknown_correct-1"), "i4": ("unknown", "mine"), "i5": ("8", "8_correct-1")}
    assert documents.metadata_table(entries.where("false"), "image_name").columns == ["image_name"]


def test_user_aggregates(spark):
    class Range:
        def __init__(self):
            self.low, self.high = float("inf"), float("-inf")

        def step(self, value):
            self.low, self.high = min(self.low, value), max(self.high, value)

        def finalize(self, scale=1.0):
            return (self.high - self.low) * scale if self.high >= self.low else None

    extensions.register_aggregate(spark, "value_range", Range, "double")
    extensions.register_aggregate(spark, "np_quantile", lambda: extensions.Collected(np.quantile), "double")
    df = spark.createDataFrame([("x", 1.0), ("x", 4.0), ("x", None), ("y", 2.0), ("z", None)], "g string, v double")
    got = {r.g: (r.a, r.b) for r in sql("SELECT g, value_range(v) AS a, value_range(v, 'scale=2') AS b FROM df GROUP BY g", {"df": df}).collect()}
    assert got == {"x": (3.0, 6.0), "y": (0.0, 0.0), "z": (None, None)}
    assert sql("SELECT np_quantile(v, 'q=0.25', 'method=lower') AS q FROM df WHERE g = 'x'", {"df": df}).first().q == 1.0
    assert extensions.options(["a=1e3", "b = x=y", "c=-.5"]) == {"a": 1000.0, "b": "x=y", "c": -0.5}
    with pytest.raises(ValueError, match="name=value"):
        extensions.options(["a"])


def test_transformations_with_validity(spark):
    def erase(c):
        return c.withColumn("valid", F.col("valid") & ~((F.col("col") >= F.floor(F.col("u") * 10)) & (F.col("col") < F.floor(F.col("u") * 10) + 4)))

    kept = F.count_if("valid") >= 8  # erased regions must hang over the edge
    registry = extensions.Registry()
    registry.add(extensions.Transformation("erase", erase, ("u",), kept))
    registry.add(extensions.Transformation("double", lambda c: c.withColumn("value", F.col("value") * 2)))
    registry.add(extensions.Transformation("never", lambda c: c, ("u",), F.lit(False) & (F.count("*") > 0)))
    df = spark.createDataFrame([(f"i{i}", c, True, float(c)) for i in range(12) for c in range(10)], "image string, col int, valid boolean, value double")
    out = registry.apply(df, "image", ["erase", "double"])
    assert out.columns == df.columns
    rows = {}
    for r in out.collect():
        rows.setdefault(r.image, {})[r.col] = (r.valid, r.value)
    assert len(rows) == 12 and all(sum(v for v, _ in x.values()) >= 8 and x[3][1] == 6.0 for x in rows.values())
    # the first valid attempt, by hand
    u = df.select("image").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("image", "k", bootstrap.uniform(0, F.lit("0/0/erase"), F.col("image"), F.col("k"), F.lit("u")).alias("u")).collect()
    for image, x in rows.items():
        first = min((r.k, r.u) for r in u if r.image == image and int(r.u * 10) >= 8)[1]
        assert sorted(c for c in x if not x[c][0]) == [c for c in range(int(first * 10), 10)]
    again = registry.apply(df.repartition(5), "image", ["erase", "double"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(Exception, match="never: no valid attempt"):
        registry.apply(df, "image", ["never"]).collect()
    with pytest.raises(KeyError, match="known: double, erase, never"):
        registry.get("other")
    with pytest.raises(ValueError, match="already"):
        registry.add(registry.get("erase"))


def test_bootstrapped_curves_equal_the_exploded_way(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k % 25}", float(x), int(rng.random() < x)) for k, x in enumerate(np.clip(rng.normal(0.5, 0.3, 300), -0.1, 1.1))]
    df = spark.createDataFrame([*rows, ("s1", None, 1), ("s2", float("nan"), 0)], "unit string, score double, label int")
    n, steps = 60, 50
    got = curves.bootstrapped_roc(df, "unit", "score", "label", n, steps)
    exploded = bootstrap.resampled(df, [], "unit", n).join(df, "unit")
    want = metrics.roc(exploded, ["bootstrap"], "score", "label", steps)
    key = lambda r: (r.bootstrap, round(r.threshold, 9))
    a, b = ({key(r): (r.tpr, r.fpr) for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and len(a) == n * steps
    assert all(np.allclose(a[k], b[k]) for k in a)
    area = {r.bootstrap: r.auc for r in curves.areas(got).collect()}
    for i in range(n):
        points = sorted(v for (j, _), v in a.items() if j == i)
        x, y = [0.0, *(p[1] for p in sorted(points, key=lambda p: (p[1], p[0]))), 1.0], [0.0, *(p[0] for p in sorted(points, key=lambda p: (p[1], p[0]))), 1.0]
        assert area[i] == pytest.approx(np.trapezoid(y, x))
    s = {round(r.threshold, 9): r for r in curves.summary(got).collect()}
    for t, r in s.items():
        v = [x[0] for (_, u), x in b.items() if u == t]
        assert (r.mean, r.low, r.high) == (pytest.approx(np.mean(v)), pytest.approx(np.quantile(v, 0.025)), pytest.approx(np.quantile(v, 0.975)))


def test_lightness(spark):
    # hand-computed colours
    colours = {(0, 0, 0): 0.0, (255, 255, 255): 100.0, (255, 0, 0): 53.24, (0, 255, 0): 87.735, (0, 0, 255): 32.30, (128, 128, 128): 53.585, (5, 5, 5): 1.371}
    df = spark.createDataFrame([k for k in colours], "r int, g int, b int")
    got = {(r.r, r.g, r.b): r for r in df.select("*", cells.lightness(F.col("r"), F.col("g"), F.col("b")).alias("l"), cells.specular(F.col("r"), F.col("g"), F.col("b"), 85).alias("s")).collect()}
    assert all(got[k].l == pytest.approx(v, abs=0.02) for k, v in colours.items())
    assert {k for k in got if got[k].s} == {(255, 255, 255), (0, 255, 0)}


def test_units_are_numbered_by_ranges(spark):
    """More units than a lot used to be numbered in one task; ranges give the same numbers."""
    for make, kind in ((lambda i: i * 7 % 3001, "long"), (lambda i: f"s{i * 7 % 3001}", "string")):
        df = spark.createDataFrame([("uv"[i % 3 == 0], make(i)) for i in range(3000)] * 2 + [("u", None)], f"g string, unit {kind}")
        for keys in ([], ["g"]):
            (small, _), (large, n) = bootstrap.places(df, keys, "unit"), bootstrap.places(df, keys, "unit", lot=400)
            columns = [*keys, "unit", "_p", "_n"]
            assert sorted(map(str, small.select(columns).collect())) == sorted(map(str, large.select(columns).collect())) and n == small.count()
            assert "_range" in large._jdf.queryExecution().optimizedPlan().toString() and "_range" not in small._jdf.queryExecution().optimizedPlan().toString()
