"""Data sources that read byte ranges: spectral cubes by column and row, array archives by key and row.

``register(spark)`` makes the formats known:

* ``spectral_cubes``: ``image_name``, ``row``, ``col``, ``spectrum``.  A partition is a run of image columns
  of one file; of each column only the bytes of the wanted rows are read.
* ``array_archive``: ``file``, ``row`` (along the first axis) and a column for each key that the schema names,
  ``spark.read.format("array_archive").schema("file string, row int, data array<float>")``.  The
  archive's directory is read first; the bytes of other keys are passed over, and of stored
  (not compressed) arrays only the wanted rows' bytes are read.

What is read is chosen by options, which plan the partitions: ``names`` (of images or files, with commas),
``rows`` and ``cols`` (``from:to``, the end left out; either may be missing); further ``glob`` (of file
names) and ``bytesPerPartition``.  Any file system that pyarrow opens will do.

With the option ``pushdown`` filters on names, ``row`` and ``col`` are taken from the query; the session needs
``spark.sql.python.filterPushdown.enabled``.  It is off by default, as Spark 4.1 keeps the filters first
pushed into a relation for all later queries of the same DataFrame: every query then needs a
``load`` of its own.
"""

from __future__ import annotations

import fnmatch
import io
import math
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

PARTITION_BYTES = 32 << 20


def fetch(f, offset: int, length: int) -> bytes:
    """``length`` bytes from ``offset`` on; every byte that a reader takes comes through here."""
    return f.read_at(length, offset)


def opened(path: str):
    fs, at = pa.fs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def files(path: str, pattern: str) -> list[tuple[str, int]]:
    """Files below a folder whose names fit, with their sizes, in order."""
    fs, at = pa.fs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type == pa.fs.FileType.File:
        found = [fs.get_file_info(at)]
    else:
        found = [i for i in fs.get_file_info(pa.fs.FileSelector(at, recursive=True)) if i.type == pa.fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)]
    head = re.match(r"^[a-z0-9]+://[^/]*(?=/)", path)
    return sorted(((head.group() if head else "") + i.path, i.size) for i in found)


class Ranges(io.RawIOBase):
    """A file for Python's readers on top of ``fetch``."""

    def __init__(self, f):
        self.f, self.at, self.size = f, 0, f.size()

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def readinto(self, buffer) -> int:
        got = fetch(self.f, self.at, min(len(buffer), max(0, self.size - self.at)))
        buffer[: len(got)] = got
        self.at += len(got)
        return len(got)


@dataclass
class Wanted:
    """What filters leave of a name and of whole-number axes (ends included)."""

    names: list[set] = field(default_factory=list)
    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)

    def take(self, f: D.Filter, name: str, axes: tuple[str, ...]) -> bool:
        """Whether the filter is held by this alone from now on."""
        kind, column = type(f), getattr(f, "attribute", (None,))
        if len(column) != 1:
            return False
        column = column[0]
        if kind is D.IsNotNull and column in (name, *axes):
            return True
        if column == name and kind in (D.EqualTo, D.In):
            self.names.append({f.value} if kind is D.EqualTo else set(f.value))
            return True
        if column in axes and kind in (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual) and isinstance(f.value, int):
            if kind in (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual):
                self.low[column] = max(self.low.get(column, 0), f.value + (kind is D.GreaterThan))
            if kind in (D.EqualTo, D.LessThan, D.LessThanOrEqual):
                self.high[column] = min(self.high.get(column, 1 << 62), f.value - (kind is D.LessThan))
            return True
        return False

    def named(self, name: str) -> bool:
        return all(name in s for s in self.names)

    def span(self, axis: str, size: int) -> range:
        return range(max(0, self.low.get(axis, 0)), min(size, self.high.get(axis, size) + 1))


@dataclass
class Piece(D.InputPartition):
    path: str
    start: int
    stop: int


class _Reader(D.DataSourceReader):
    name, axes = "", ()

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema, self.wanted = options, schema, Wanted()
        if options.get("names"):
            self.wanted.names.append(set(options["names"].split(",")))
        for axis in self.axes:
            low, _, high = options.get(f"{axis}s", ":").partition(":")
            self.wanted.low |= {axis: int(low)} if low else {}
            self.wanted.high |= {axis: int(high) - 1} if high else {}
        self.path = options["path"]
        self.bytes = int(options.get("bytesPerPartition", PARTITION_BYTES))

    def runs(self, span: range, bytes_each: int) -> Iterator[tuple[int, int]]:
        step = max(1, self.bytes // max(1, bytes_each))
        for a in range(span.start, span.stop, step):
            yield a, min(a + step, span.stop)


class _Pushing:
    """Takes filters from Spark's plan."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if not self.wanted.take(f, self.name, self.axes):
                yield f


def image_name(path: str) -> str:
    return path.split("/")[-2] if "/" in path else ""


def _chosen(options: dict, plain: type, pushing: type) -> type:
    return pushing if options.get("pushdown", "").lower() == "true" else plain


class CubeReader(_Reader):
    name, axes = "image_name", ("row", "col")

    def partitions(self) -> list[Piece]:
        out = []
        for path, _ in files(self.path, self.options.get("glob", "*SpecCube.dat")):
            if self.wanted.named(image_name(path)):
                with opened(path) as f:
                    width, height, channels = struct.unpack(">iii", fetch(f, 0, 12))
                rows = len(self.wanted.span("row", height))
                out += [Piece(path, a, b) for a, b in self.runs(self.wanted.span("col", width), 4 * channels * rows) if rows]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece is None or piece.path is None:
            return
        with opened(piece.path) as f:
            _, height, channels = struct.unpack(">iii", fetch(f, 0, 12))
            rows = self.wanted.span("row", height)
            for col in range(piece.start, piece.stop):
                # columns are stored upwards
                first, last = height - rows.stop, height - rows.start
                raw = fetch(f, 12 + 4 * channels * (col * height + first), 4 * channels * (last - first))
                values = np.frombuffer(raw, ">f4").reshape(last - first, channels)[::-1].astype(np.float32)
                yield self.batch(piece.path, np.arange(rows.start, rows.stop), col, values)

    def batch(self, path: str, rows: np.ndarray, col: int, values: np.ndarray) -> pa.RecordBatch:
        n, made = len(rows), {}
        for f in self.schema.fields:
            if f.name == "spectrum":
                made[f.name] = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float32()))
            else:
                made[f.name] = {"image_name": lambda: pa.array([image_name(path)] * n), "row": lambda: pa.array(rows.astype(np.int32)), "col": lambda: pa.array(np.full(n, col, np.int32))}[f.name]()
        return pa.RecordBatch.from_pydict(made)


class PushingCubeReader(_Pushing, CubeReader):
    pass


class CubeSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "spectral_cubes"

    def schema(self) -> str:
        return "image_name string, row int, col int, spectrum array<float>"

    def reader(self, schema: T.StructType) -> CubeReader:
        return _chosen(self.options, CubeReader, PushingCubeReader)(self.options, schema)


@dataclass
class Member:
    """An array in an archive: where its values begin (nowhere, if compressed), their kind and shape."""

    name: str
    at: int | None
    kind: np.dtype
    shape: tuple[int, ...]
    fortran: bool

    @property
    def row_bytes(self) -> int:
        return self.kind.itemsize * math.prod(self.shape[1:])


def _header(start: bytes) -> tuple[int, np.dtype, tuple[int, ...], bool]:
    f = io.BytesIO(start)
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    return f.tell(), kind, shape, fortran


def members(f, keys: set[str]) -> dict[str, Member]:
    """The wanted arrays of an archive, from its directory and their own headers."""
    out = {}
    with zipfile.ZipFile(Ranges(f)) as z:
        for info in z.infolist():
            key = info.filename.removesuffix(".npy")
            if key not in keys:
                continue
            if info.compress_type == zipfile.ZIP_STORED:
                name, extra = struct.unpack("<HH", fetch(f, info.header_offset + 26, 4))
                begin = info.header_offset + 30 + name + extra
                size, kind, shape, fortran = _header(fetch(f, begin, min(info.file_size, 256)))
                out[key] = Member(info.filename, begin + size, kind, shape, fortran)
            else:
                with z.open(info) as m:
                    size, kind, shape, fortran = _header(m.read(256))
                out[key] = Member(info.filename, None, kind, shape, fortran)
    return out


class ArchiveReader(_Reader):
    name, axes = "file", ("row",)

    def keys(self) -> set[str]:
        return {f.name for f in self.schema.fields} - {"file", "row"}

    def partitions(self) -> list[Piece]:
        out = []
        for path, _ in files(self.path, self.options.get("glob", "*.npz")):
            if self.wanted.named(path.rsplit("/", 1)[-1]):
                with opened(path) as f:
                    found = members(f, self.keys()).values()
                n = max([m.shape[0] if m.shape else 1 for m in found], default=0)
                whole = any(m.at is None or m.fortran for m in found)  # compressed arrays are read once, in one piece
                span = self.wanted.span("row", n)
                out += [Piece(path, a, b) for a, b in ([(span.start, span.stop)] if whole and len(span) else self.runs(span, sum(m.row_bytes for m in found)))]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece is None or piece.path is None:
            return
        n, made = piece.stop - piece.start, {}
        with opened(piece.path) as f:
            found = members(f, self.keys())
            for column in self.schema.fields:
                if column.name == "file":
                    made["file"] = pa.array([piece.path.rsplit("/", 1)[-1]] * n)
                elif column.name == "row":
                    made["row"] = pa.array(np.arange(piece.start, piece.stop, dtype=np.int32))
                else:
                    made[column.name] = self.values(f, found.get(column.name), column.dataType, piece)
        yield pa.RecordBatch.from_pydict(made)

    @staticmethod
    def values(f, m: Member | None, kind: T.DataType, piece: Piece) -> pa.Array:
        """A key's rows; null where the archive or the array has none."""
        n = piece.stop - piece.start
        if m is None:
            return pa.nulls(n, pa.list_(_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else _arrow(kind))
        shape = m.shape or (1,)
        start, stop = min(piece.start, shape[0]), min(piece.stop, shape[0])
        if m.at is not None and not m.fortran:
            rows = np.frombuffer(fetch(f, m.at + start * m.row_bytes, (stop - start) * m.row_bytes), m.kind)
        else:
            with zipfile.ZipFile(Ranges(f)) as z, z.open(m.name) as part:
                raw = part.read()
            rows = np.frombuffer(raw[_header(raw[:256])[0] :], m.kind).reshape(shape, order="F" if m.fortran else "C")[start:stop]
        rows = rows.reshape(stop - start, -1) if stop > start else np.zeros((0, 1), m.kind)
        rows = rows.astype(rows.dtype.newbyteorder("="))
        if isinstance(kind, T.ArrayType):
            inner = _arrow(kind.elementType)
            lists = pa.array([pa.array(r).cast(inner).to_pylist() for r in rows] + [None] * (n - len(rows)), pa.list_(inner))
            return lists
        return pa.concat_arrays([pa.array(rows[:, 0]).cast(_arrow(kind)), pa.nulls(n - len(rows), _arrow(kind))])


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class PushingArchiveReader(_Pushing, ArchiveReader):
    pass


class ArchiveSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_archive"

    def schema(self) -> str:
        return "file string, row int, data array<double>"

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return _chosen(self.options, ArchiveReader, PushingArchiveReader)(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    for source in (CubeSource, ArchiveSource):
        spark.dataSource.register(source)
