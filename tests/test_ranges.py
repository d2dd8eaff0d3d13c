"""Byte-range sources: results, and that bytes read fall with what is asked for."""

import struct

import numpy as np
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumaquery.sources import files, ranges

SHAPE = (6, 5, 4)  # width, height, channels


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("cubes")
    rng = np.random.default_rng(0)
    for name in ("a", "b"):
        (top / name).mkdir()
        (top / name / f"{name}_SpecCube.dat").write_bytes(struct.pack(">iii", *SHAPE) + rng.normal(size=SHAPE).astype(">f4").tobytes())
    big = rng.normal(size=(1000, 64))
    np.savez(top / "a" / "x.npz", data=big, label=np.arange(1000, dtype=np.int16), short=np.arange(3.0))
    np.savez_compressed(top / "b" / "y.npz", data=big[:10], label=np.arange(10, dtype=np.int16))
    np.savez(top / "b" / "f.npz", data=np.asfortranarray(big[:4]), label=np.array(7))
    return str(top), big


@pytest.fixture
def counted(monkeypatch):
    taken = []
    plain = ranges.fetch

    def fetch(f, offset, length):
        got = plain(f, offset, length)
        taken.append(len(got))
        return got

    monkeypatch.setattr(ranges, "fetch", fetch)
    return taken


def read(reader, counted, filters=()):
    left = list(reader.pushFilters(list(filters)))
    pieces = reader.partitions()
    counted.clear()
    rows = [r for p in pieces for b in reader.read(p) for r in b.to_pylist()]
    return rows, sum(counted), left, len(pieces)


def test_cubes(spark, folder):
    path, _ = folder
    ranges.register(spark)
    df = spark.read.format("spectral_cubes").option("bytesPerPartition", 200).load(path)
    key = lambda r: (r.image_name, r.row, r.col, tuple(r.spectrum))
    want = sorted(map(key, files.cubes(spark, path).collect()))
    assert sorted(map(key, df.collect())) == want and df.rdd.getNumPartitions() > 2
    some = df.where("image_name = 'b' and col >= 2 and col < 4 and row > 1 and spectrum[0] > 0")
    kept = [r for r in want if r[0] == "b" and 2 <= r[2] < 4 and r[1] > 1 and r[3][0] > 0]
    assert sorted(map(key, some.collect())) == kept and df.groupBy("image_name").count().count() == 2
    chosen = spark.read.format("spectral_cubes").option("names", "b,z").option("cols", "2:4").option("rows", "2:").load(path)
    assert sorted(map(key, chosen.where("spectrum[0] > 0").collect())) == kept
    assert spark.read.format("spectral_cubes").option("cols", "50:").load(path).collect() == []


def test_pushed_filters(spark, folder):
    path, _ = folder
    ranges.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("spectral_cubes").option("pushdown", "true").load(path)
        assert load().where("image_name = 'b' and col >= 2 and col < 4 and row > 1").count() == 6
        assert load().where("image_name in ('a', 'q') and spectrum[0] > 0").where("row = 0").count() == load().where("image_name = 'a' and row = 0 and spectrum[0] > 0").count()
        assert load().where("col = 100 or row < 0").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bytes_of_cubes(folder, counted):
    path, _ = folder
    schema = T.StructType([T.StructField("image_name", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("spectrum", T.ArrayType(T.FloatType()))])
    make = lambda: ranges.PushingCubeReader({"path": path}, schema)
    rows, whole, _, _ = read(make(), counted)
    assert len(rows) == 2 * 30 and whole == 2 * (12 + 4 * 6 * 5 * 4)
    other = D.EqualTo(("spectrum",), 1)
    rows, some, left, _ = read(make(), counted, [D.EqualTo(("image_name",), "a"), D.GreaterThanOrEqual(("col",), 4), D.LessThan(("row",), 2), other])
    assert left == [other] and len(rows) == 4 and some == 12 + 2 * 2 * 4 * 4  # two columns, two rows, four channels


def test_archives(spark, folder):
    path, big = folder
    ranges.register(spark)
    df = spark.read.format("array_archive").schema("file string, row int, data array<double>, label int, none float").option("bytesPerPartition", 20_000).load(path)
    rows = {(r.file, r.row): r for r in df.collect()}
    assert len(rows) == 1000 + 10 + 4 and all(r.none is None for r in rows.values())
    assert np.array_equal([rows["x.npz", i].data for i in range(1000)], big) and [rows["x.npz", i].label for i in range(1000)] == list(range(1000))
    assert np.array_equal([rows["y.npz", i].data for i in range(10)], big[:10]) and np.array_equal([rows["f.npz", i].data for i in range(4)], big[:4])
    assert [rows["f.npz", i].label for i in range(4)] == [7, None, None, None]
    few = df.where((F.col("file") == "x.npz") & F.col("row").between(10, 12)).select("label")
    assert sorted(r.label for r in few.collect()) == [10, 11, 12]


def test_bytes_of_archives(folder, counted):
    path, _ = folder
    kind = {"data": T.ArrayType(T.DoubleType()), "label": T.IntegerType(), "short": T.DoubleType()}
    make = lambda *names: ranges.PushingArchiveReader({"path": path + "/a", "bytesPerPartition": "100000"}, T.StructType([T.StructField("row", T.IntegerType()), *[T.StructField(n, kind[n]) for n in names]]))
    every, all_bytes, _, pieces = read(make("data", "label", "short"), counted)
    assert len(every) == 1000 and pieces > 4 and all_bytes > 1000 * 64 * 8
    _, label_bytes, _, _ = read(make("label"), counted)
    assert 2000 <= label_bytes < 6000
    rows, row_bytes, _, _ = read(make("data"), counted, [D.GreaterThan(("row",), 4), D.LessThanOrEqual(("row",), 9)])
    assert [r["row"] for r in rows] == [5, 6, 7, 8, 9] and 5 * 512 <= row_bytes < 5 * 512 + 4000
    short, _, _, _ = read(make("short"), counted)
    assert [r["short"] for r in short] == [0.0, 1.0, 2.0]
