"""Camera files as rows: cubes, calibration arrays, masks, images and metadata.

Files come through Spark's binary and text readers, so any store that Spark reads
will do; a decoder sees one file's bytes at a time.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The wavelength axis of a cube, in nm.
WAVELENGTHS = [500 + 500 * i / 99 for i in range(100)]


def binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path`` and ``content`` of the files below a folder that a glob pattern names."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def image_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def decode_cube(content: bytes) -> np.ndarray:
    """(height, width, channels) from three big-endian sizes and big-endian floats stored by column, y upwards."""
    w, h, c = struct.unpack(">iii", content[:12])
    cube = np.frombuffer(content, ">f4", offset=12).reshape(w, h, c)
    return np.ascontiguousarray(np.flip(cube, 1).swapaxes(0, 1)).astype(np.float32)


def cubes(spark: SparkSession, path: str, pattern: str = "*SpecCube.dat", rows_at_a_time: int = 20_000) -> DataFrame:
    """One row a pixel: (image_name, row, col, spectrum)."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["image_name"], pdf["content"], strict=True):
                cube = decode_cube(content)
                flat = cube.reshape(-1, cube.shape[2])
                for i in range(0, len(flat), rows_at_a_time):
                    at = np.arange(i, min(i + rows_at_a_time, len(flat)))
                    yield pd.DataFrame({"image_name": name, "row": at // cube.shape[1], "col": at % cube.shape[1], "spectrum": list(flat[at])})

    files = binary(spark, path, pattern).select(image_name(F.col("path")).alias("image_name"), "content")
    return files.mapInPandas(work, "image_name string, row int, col int, spectrum array<float>")


def dark_patterns(spark: SparkSession, path: str, pattern: str = "*DarkPattern.dat") -> DataFrame:
    """One row a line of a calibration array: (image_name, row, values)."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["image_name"], pdf["content"], strict=True):
                h, c = struct.unpack(">ii", content[:8])
                values = np.frombuffer(content, ">f8", offset=8).reshape(h, c).astype(float)
                yield pd.DataFrame({"image_name": name, "row": np.arange(h), "values": list(values)})

    files = binary(spark, path, pattern).select(image_name(F.col("path")).alias("image_name"), "content")
    return files.mapInPandas(work, "image_name string, row int, values array<double>")


def numpy_arrays(spark: SparkSession, path: str, pattern: str = "*.np[yz]") -> DataFrame:
    """Arrays of numpy files as (image_name, shape, values); of an archive its ``data``."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for pdf in parts:
            rows = []
            for name, content in zip(pdf["image_name"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a["data"] if hasattr(a, "files") else a
                rows.append((name, list(a.shape), a.ravel().astype(float).tolist()))
            yield pd.DataFrame(rows, columns=["image_name", "shape", "values"])

    files = binary(spark, path, pattern).select(image_name(F.col("path")).alias("image_name"), "content")
    return files.mapInPandas(work, "image_name string, shape array<int>, values array<double>")


def masks(spark: SparkSession, path: str, pattern: str = "*.nrrd") -> DataFrame:
    """Layers of raw or gzip label volumes: (image_name, layer, row, col, label_index), background left out."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        kinds = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "unsigned short": "u2"}
        for pdf in parts:
            for name, content in zip(pdf["image_name"], pdf["content"], strict=True):
                head, _, body = content.partition(b"\n\n")
                fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\n") if ": " in x)
                sizes = [int(x) for x in fields["sizes"].split()]
                data = gzip.decompress(body) if fields.get("encoding", "raw").startswith("g") else body
                a = np.frombuffer(data, kinds[fields["type"]]).reshape(sizes, order="F")
                a = a.reshape((1, *a.shape[:2])) if a.ndim == 2 else a if a.ndim == 3 and a.shape[0] < 32 else np.moveaxis(a, -1, 0)
                layer, col, row = np.nonzero(a)
                yield pd.DataFrame({"image_name": name, "layer": layer, "row": row, "col": col, "label_index": a[layer, col, row].astype(int)})

    files = binary(spark, path, pattern).select(image_name(F.col("path")).alias("image_name"), "content")
    return files.mapInPandas(work, "image_name string, layer int, row int, col int, label_index int")


def windows_text(content: Column) -> Column:
    """Bytes of code page 1252, which differs from Latin-1 in the C1 range only."""
    c1 = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, c1)), bytes(c1).decode("cp1252"))


def log_metadata(spark: SparkSession, path: str, pattern: str = "*_meta.log") -> DataFrame:
    """(image_name, key, value) of section files in code page 1252; keys are ``Section_Key``, decimal commas become points."""
    files = binary(spark, path, pattern)
    lines = F.split(windows_text(F.col("content")), r"\r?\n")
    sections = F.aggregate(
        lines,
        F.struct(F.lit("").alias("section"), F.array().cast("array<struct<key:string,value:string>>").alias("found")),
        lambda a, x: F.struct(
            F.when(x.rlike(r"^\[.*\]\s*$"), F.regexp_extract(x, r"^\[(.*)\]", 1)).otherwise(a["section"]).alias("section"),
            F.when(
                x.rlike(r"^[^\[=]+="),
                F.array_append(a["found"], F.struct(F.concat_ws("_", F.nullif(a["section"], F.lit("")), F.trim(F.regexp_extract(x, r"^([^=]+)=", 1))).alias("key"), F.trim(F.regexp_extract(x, r"^[^=]+=(.*)$", 1)).alias("value"))),
            ).otherwise(a["found"]).alias("found"),
        ),
    )
    rows = files.select(image_name(F.col("path")).alias("image_name"), F.explode(sections["found"]).alias("m"))
    plain = F.regexp_replace("m.value", '^"(.*)"$', "$1")
    number = F.regexp_replace(plain, r"^(-?\d+),(\d+)$", "$1.$2")
    return rows.select("image_name", "m.key", number.alias("value"))


def xml_metadata(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """(image_name, key, value) of flat XML files: element name and text."""
    files = binary(spark, path, pattern).select(image_name(F.col("path")).alias("image_name"), F.decode("content", "UTF-8").alias("x"))
    pairs = F.arrays_zip(F.regexp_extract_all("x", F.lit(r"<([A-Za-z_][\w.\-]*)[^<>/]*>([^<>]*)</\1>"), F.lit(1)).alias("key"), F.regexp_extract_all("x", F.lit(r"<([A-Za-z_][\w.\-]*)[^<>/]*>([^<>]*)</\1>"), F.lit(2)).alias("value"))
    return files.select("image_name", F.inline(pairs)).withColumn("value", F.trim("value"))


def wide_metadata(long: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Declared keys as columns of declared types, null where they don't fit."""
    wide = long.groupBy("image_name").pivot("key", list(schema)).agg(F.first("value"))
    return wide.select("image_name", *[F.col(f"`{k}`").try_cast(t).alias(k) for k, t in schema.items()])


def json_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("recursiveFileLookup", "true").json(path)


def spectrometer(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file, label, at, wavelength, value) of text measurements: the lines of two numbers after the data header."""
    text = binary(spark, path, pattern).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("x"))
    lines = F.split(F.regexp_replace("x", r"(?s)^.*?>+Begin[^\n]*\n", ""), r"\r?\n")
    rows = text.select("file", F.regexp_extract("file", r"^(.*?)(?:[_\-]\d+)?\.[^.]*$", 1).alias("label"), F.posexplode(lines).alias("at", "line"))
    parts = F.split(F.trim(F.translate("line", ",", ".")), r"\s+")
    return rows.where(F.size(parts) == 2).select("file", "label", "at", parts[0].try_cast("double").alias("wavelength"), parts[1].try_cast("double").alias("value")).where("wavelength is not null and value is not null")


def spectrometer_statistics(rows: DataFrame, white: str | None = None, dark: str | None = None, norm: int | None = None) -> DataFrame:
    """(label, at, wavelength, mean, median, std, n) over the measurements of each label from ``spectrometer``.

    With the labels of white and dark measurements values become (x - dark) / (white - dark), by the
    means of these measurements, which then drop out; with ``norm`` each measurement is divided by its Lp norm.
    """
    for label, name in ((white, "_white"), (dark, "_dark")):
        if label:
            rows = rows.join(rows.where(F.col("label") == label).groupBy("at").agg(F.avg("value").alias(name)), "at")
    if white or dark:
        rows = rows.where(~F.col("label").isin([x for x in (white, dark) if x]))
        low = F.col("_dark") if dark else F.lit(0.0)
        rows = rows.withColumn("value", (F.col("value") - low) / ((F.col("_white") - low) if white else F.lit(1.0)))
    if norm:
        size = F.pow(F.sum(F.pow(F.abs("value"), F.lit(float(norm)))).over(Window.partitionBy("file")), F.lit(1 / norm))
        rows = rows.withColumn("value", F.col("value") / size)
    of = rows.groupBy("label", "at")
    return of.agg(F.min("wavelength").alias("wavelength"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))


def verified_copy(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Files whose content differs between two folders or that the second lacks, by digest and path below the folder."""

    def digest(root: str) -> DataFrame:
        below = F.regexp_replace("path", "^.*" + re.escape(root.rstrip("/").split(":")[-1].lstrip("/")) + "/", "")
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(below.alias("name"), F.sha2("content", 256).alias("d"))

    a, b = digest(source), digest(target).withColumnRenamed("d", "e")
    return a.join(b, "name", "left").where(~F.col("d").eqNullSafe(F.col("e"))).select("name")


def write_if_absent(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def colour_images(spark: SparkSession, path: str, pattern: str = "*RGB-Image.png", border: tuple[int, int, int, int] = (30, 3, 3, 3), height: int = 480, width: int = 640) -> DataFrame:
    """One row a pixel of camera pictures (image_name, row, col, r, g, b), without the border (top, right,
    bottom, left) that the camera's program draws; another size than ``height`` by ``width`` is an error.

    Pictures are decoded by Spark's image source, whose channels are blue, green, red, row by row.
    """
    top, right, bottom, left = border
    raw = spark.read.format("image").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("image.*")
    fits = (F.col("height") == height + top + bottom) & (F.col("width") == width + left + right) & (F.col("nChannels") == 3)
    size = F.concat_ws(" ", F.lit("unexpected size of"), "origin", F.col("height").cast("string"), F.col("width").cast("string"), F.col("nChannels").cast("string"))
    checked = raw.where(F.when(fits, True).otherwise(F.raise_error(size).cast("boolean")))
    lines = checked.select(image_name(F.col("origin")).alias("image_name"), "data", "width", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row"))
    line = lines.select("image_name", "row", F.expr(f"substring(data, int((row + {top}) * width * 3 + {left} * 3 + 1), {width * 3})").alias("_line"))
    cells = line.select("image_name", "row", F.hex("_line").alias("_hex"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    channel = lambda k: F.conv(F.expr(f"substring(_hex, col * 6 + {2 * k + 1}, 2)"), 16, 10).cast("int")
    return cells.select("image_name", "row", "col", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def first_existing(spark: SparkSession, locations: list[str], needed: str) -> str:
    """The location of a table kept in several places: the first one that has ``needed``, else the first that
    exists, else an error."""
    jvm = spark._jvm

    def exists(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    found = [x for x in locations if exists(f"{x}/{needed}")] or [x for x in locations if exists(x)]
    if not found:
        raise FileNotFoundError(f"none of {locations} exists")
    return found[0]


def best_location(spark: SparkSession, locations: list[str], needle: str | None = None, writing: bool = False) -> str:
    """The most suitable of several places of one thing.

    With a ``needle``, the place that holds it in its path (the folder's path, where all places have the same
    last name; of several the one most alike to it, by difflib's ratio), if it exists or is
    wanted for ``writing``; else the first place that exists; else the needle's, or the first.
    """
    from difflib import SequenceMatcher

    def exists(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    matched = None
    if needle is not None:
        same = len({x.rstrip("/").rsplit("/", 1)[-1] for x in locations}) == 1
        searched = {x: x.rstrip("/").rsplit("/", 1)[0] if same else x for x in locations}
        fits = [x for x in locations if needle in searched[x]]
        matched = max(fits, key=lambda x: SequenceMatcher(None, needle, x).ratio(), default=None)
    if matched is not None and (writing or exists(matched)):
        return matched
    return next((x for x in locations if exists(x)), matched or locations[0])
