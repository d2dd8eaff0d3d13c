"""Readers, sinks and streams on files of their own."""

import json
import struct

import numpy as np
from pyspark.sql import functions as F

from lumaquery.functions.labels import LabelMapping
from lumaquery.sources import files as S
from lumaquery.sources import tables as T
from lumaquery.streaming import streams as X


def folder(tmp_path, name, content, image="s#2020_01_01_00_00_00"):
    at = tmp_path / image
    at.mkdir(exist_ok=True)
    (at / name).write_bytes(content)
    return str(tmp_path)


def test_cube(spark, tmp_path):
    cube = np.arange(24, dtype=np.float32).reshape(2, 3, 4)  # height, width, channels
    stored = np.flip(cube.swapaxes(0, 1), 1).astype(">f4")
    path = folder(tmp_path, "x_SpecCube.dat", struct.pack(">iii", 3, 2, 4) + stored.tobytes())
    got = {(r.row, r.col): r.spectrum for r in S.cubes(spark, path, rows_at_a_time=4).collect()}
    assert all(got[r, c] == cube[r, c].tolist() for r in range(2) for c in range(3))


def test_arrays_and_masks(spark, tmp_path):
    import io

    folder(tmp_path, "d_DarkPattern.dat", struct.pack(">ii", 2, 3) + np.arange(6).astype(">f8").tobytes())
    assert [r["values"] for r in S.dark_patterns(spark, str(tmp_path)).orderBy("row").collect()] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    buffer = io.BytesIO()
    np.savez(buffer, data=np.ones((2, 2)))
    folder(tmp_path, "a.npz", buffer.getvalue())
    assert S.numpy_arrays(spark, str(tmp_path)).first()["shape"] == [2, 2]
    mask = np.zeros((4, 3), np.uint8)
    mask[1, 2] = 7  # column 1, row 2
    folder(tmp_path, "m.nrrd", b"NRRD0004\ntype: uchar\ndimension: 2\nsizes: 4 3\nencoding: raw\n\n" + mask.tobytes(order="F"))
    assert [tuple(r)[1:] for r in S.masks(spark, str(tmp_path)).collect()] == [(0, 2, 1, 7)]


def test_metadata(spark, tmp_path):
    folder(tmp_path, "x_meta.log", '[Camera]\r\nName = "Tïvi€"\r\nTime=1,5\r\n[Other]\r\nflag=true\r\n'.encode("cp1252"))
    long = S.log_metadata(spark, str(tmp_path))
    assert {(r.key, r.value) for r in long.collect()} == {("Camera_Name", "Tïvi€"), ("Camera_Time", "1.5"), ("Other_flag", "true")}
    wide = S.wide_metadata(long, {"Camera_Time": "double", "Other_flag": "boolean", "Camera_Name": "int"}).first()
    assert wide.Camera_Time == 1.5 and wide.Other_flag is True and wide.Camera_Name is None
    folder(tmp_path, "y.xml", b"<a><Patient>p 1</Patient><Age>7</Age></a>")
    assert {(r.key, r.value) for r in S.xml_metadata(spark, str(tmp_path)).collect()} == {("Patient", "p 1"), ("Age", "7")}
    folder(tmp_path, "white_1.txt", b"Model\n>>>>>Begin Spectral Data<<<<<\n500,1\t0,25\n501.0\t0.5\n")
    assert [(r.label, r.wavelength, r.value) for r in S.spectrometer(spark, str(tmp_path)).orderBy("at").collect()] == [("white", 500.1, 0.25), ("white", 501.0, 0.5)]


def test_copy(spark, tmp_path):
    for name, content in (("a", b"1"), ("b", b"2")):
        for side in ("x", "y"):
            (tmp_path / side).mkdir(exist_ok=True)
            (tmp_path / side / name).write_bytes(content)
    (tmp_path / "y" / "b").write_bytes(b"3")
    assert [r.name for r in S.verified_copy(spark, str(tmp_path / "x"), str(tmp_path / "y")).collect()] == ["b"]


def test_spec(spark, tmp_path):
    spec = [{"fold_name": "f1", "train": {"image_names": ["a", "b"]}, "val": {"image_names": ["c"]}, "test": {"image_names": ["d"]}}]
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    table = T.spec_table(spark, str(tmp_path / "spec.json"))
    assert {tuple(r) for r in table.collect()} == {("f1", "train", "a"), ("f1", "train", "b"), ("f1", "val", "c")}
    assert T.spec_table(spark, str(tmp_path / "spec.json"), with_test=True).count() == 4
    assert [r[0] for r in T.spec_paths(table, "^tr").collect()] == ["a", "b"]
    two = table.unionByName(spark.createDataFrame([("f2", "val", "a")], "fold_name string, split_name string, image_name string"))
    want = {tuple(r) for r in two.collect()}
    assert {tuple(r) for r in T.write_spec(two, str(tmp_path / "out")).collect()} == want
    assert {tuple(r) for r in T.spec_table(spark, str(tmp_path / "out")).collect()} == want


ROWS = [
    ("semantic", "semantic#primary", "i1", "bladder", 0, 0), ("semantic", "semantic#primary", "i2", "lung", 1, 1), ("semantic", "semantic#primary", "i3", "bladder", 0, 2), ("semantic", "semantic#primary", "i4", "bladder", 0, 3),
    ("masks", "polygon#annotator1", "i1#overlap", "bladder", 0, 4), ("masks", "polygon#annotator1", "i5", "bladder", 0, 5), ("masks", "polygon#annotator2", "i1#overlap", "bladder", 0, 6), ("masks", "polygon#annotator2", "i5", "bladder", 0, 7),
]


def test_median_tables(spark, tmp_path):
    df = spark.createDataFrame([(d, "", a, i, n, k, v) for d, a, i, n, k, v in ROWS], "dataset_name string, table_name string, annotation_name string, image_name string, label_name string, label_index int, test_value int")
    T.write_median_table(df.withColumn("table_name", F.lit("plain")), str(tmp_path / "t"))
    back = T.read_median_tables(spark, str(tmp_path / "t")).withColumn("table_name", F.lit(""))
    order = {"bladder": 0, "lung": 1}
    values = lambda **k: [r.test_value for r in T.median_table(back, order=order, **k).collect()]
    assert values(dataset_name="semantic") == [0, 2, 3, 1]
    assert values(image_names=["i2", "i5"], annotation_name=["semantic#primary", "polygon#annotator1"]) == [5, 1]
    assert values(image_names=["i1", "i1"]) == [0]
    assert sorted(values(image_names=["i5@polygon#annotator2", "i1#overlap@polygon#annotator1&polygon#annotator2"])) == [4, 6, 7]
    mixed = T.median_table(back, image_names=["i2", "i5@polygon#annotator1"], order=order)
    assert all(r.label_index is None for r in mixed.collect())
    mapped = T.median_table(back, dataset_name="semantic", label_mapping=LabelMapping({"lung": 5}, 5), order=order)
    assert [(r.label_index, r.test_value) for r in mapped.collect()] == [(5, 1)]
    assert T.missing_images(df.select("image_name").distinct(), back.where("image_name <> 'i3'")).first().image_name == "i3"


def test_median_spectra(spark):
    px = spark.createDataFrame([("i", 0, [1.0, 2.0], 0.5, True), ("i", 0, [3.0, 6.0], 0.7, True), ("i", 0, [9.0, 9.0], 0.9, False), ("i", 1, [5.0, 5.0], 0.1, True)], "image string, label int, spectrum array<double>, sto2 double, used boolean")
    out = {r.label: r for r in T.median_spectra(px, ["image", "label"], "spectrum", ["sto2"], "used").collect()}
    assert out[0].n_pixels == 3 and out[0].median_spectrum == [2.0, 4.0] and np.allclose(out[0].std_spectrum, [2**0.5, 8**0.5])
    assert np.isclose(out[0].std_sto2, 0.1) and out[1].std_spectrum == [0.0, 0.0]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, float(i)) for i in range(10)], "k int, x double")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = X.file_stream(spark, str(tmp_path / "in"), rows.schema)
    q = X.running_statistics(stream, ["k"], "x").writeStream.format("memory").queryName("stats").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.k, r.n, r["mean"]) for r in spark.table("stats").collect()} == {(0, 5, 4.0), (1, 5, 5.0)}
    X.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 10
    times = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00") for i in range(30)], "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts"), F.col("k").cast("double").alias("x"))
    times.write.parquet(str(tmp_path / "ev"))
    w = X.windowed(X.file_stream(spark, str(tmp_path / "ev"), times.schema), "ts", "10 minutes", [], "x")
    q = w.writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("win").collect()) == [10, 10, 10]


def test_batches_and_patches(spark):
    df = spark.range(100).select(F.col("id").alias("image_name"))
    out = X.sample_batches(df, 8, epochs=2).collect()
    assert len(out) == 200 and len({(r.epoch, r.image_name) for r in out}) == 200
    cells = spark.createDataFrame([("i", r, c) for r in range(20) for c in range(20)], "image string, row int, col int")
    got = X.patches(cells, "image", 5, 5, 6).collect()
    assert 1 <= len(got) <= 6 and all(0 <= p.top <= 15 and 0 <= p.left <= 15 for p in got)
