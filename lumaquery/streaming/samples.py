"""Sample streams for training: endless ones, workers' slices of batches, and patches with state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from ..operators.bootstrap import numbered, uniform

#: Steps of the orders of epochs.
STEPS = 16


def steps(n: int, least: int = 1_000_000, count: int = STEPS) -> list[int]:
    """The first primes above ``least`` that don't divide n."""
    out, x = [], least | 1
    while len(out) < count:
        if n % x and all(x % d for d in range(3, int(x**0.5) + 1, 2)):
            out.append(x)
        x += 2
    return out


def drawn(numbers: DataFrame, number: str, rows: DataFrame, id_col: str, size: int, workers: int = 1, seed: int = 0) -> DataFrame:
    """Rows for running numbers 0, 1, ..: ``epoch``, ``batch``, ``slot``, ``worker`` and the row's columns.

    An epoch is all rows once, in an order of its own: rows are numbered in a random order, and an epoch
    walks through them from a drawn start by a drawn step that has no divisor in common with their number.
    So a number alone gives its row, without state: any part of the stream can be made again.
    A batch has ``size`` slots, of which each worker fills a fixed run.
    """
    placed = numbered(rows, uniform(seed, F.col(id_col)), [id_col], "_row")
    n = placed.count()
    if not n:
        raise ValueError("there are no rows to draw from")
    epoch, number = F.floor(F.col(number) / F.lit(n)), F.col(number)
    start = F.floor(uniform(seed, F.lit("start"), epoch) * n)
    step = F.get(F.array(*[F.lit(x).cast("long") for x in steps(n)]), F.floor(uniform(seed, F.lit("step"), epoch) * STEPS).cast("int"))
    slot = F.pmod(number, F.lit(size))
    out = numbers.select(
        epoch.alias("epoch"),
        F.floor(number / F.lit(size)).alias("batch"),
        slot.cast("int").alias("slot"),
        F.floor(slot * workers / size).cast("int").alias("worker"),
        F.pmod(F.pmod(number, F.lit(n)) * step + start, F.lit(n)).alias("_row"),
    )
    return out.join(placed, "_row").drop("_row")


def endless(spark: SparkSession, rows: DataFrame, id_col: str, size: int, workers: int = 1, seed: int = 0, rows_per_batch: int = 1000) -> DataFrame:
    """A stream without end over ``rows``; see ``drawn``.  Numbers come from a rate source whose place is in the
    query's checkpoint, so a query that is started again goes on with the next number."""
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    return drawn(rate, "value", rows, id_col, size, workers, seed)


def worker_batches(df: DataFrame, size: int, workers: int, seed: int = 0, id_col: str = "image_name") -> DataFrame:
    """One pass: rows with ``worker``, ``batch``, ``slot`` and ``partly_filled``.

    Every worker has each n-th row of a random order and fills its own run of ``size / workers`` slots in
    every batch; the part of a worker's last batch may be partly filled.
    """
    part = size // workers
    rows = numbered(df, uniform(seed, F.col(id_col)), [id_col], "_i")
    rows = rows.withColumn("worker", F.pmod("_i", F.lit(workers)).cast("int")).withColumn("_j", F.floor(F.col("_i") / workers))
    out = rows.withColumns({"batch": F.floor(F.col("_j") / part), "slot": (F.col("worker") * part + F.pmod("_j", F.lit(part))).cast("int")})
    filled = F.count("*").over(Window.partitionBy("worker", "batch"))  # at most ``part`` rows
    return out.withColumn("partly_filled", filled < part).drop("_i", "_j")


def whole_parts(cells: DataFrame, image: str, id_cols: list[str], part: int, seed: int = 0) -> DataFrame:
    """Cells of each image in a random order, in parts of ``part`` cells; what is left over at an image's end is dropped."""
    draw = uniform(seed, F.col(image), *map(F.col, id_cols))
    placed = numbered(cells, draw, id_cols, "_i", [image])
    whole = cells.groupBy(image).agg((F.floor(F.count("*") / part) * part).alias("_whole"))
    return placed.join(whole, image).where(F.col("_i") < F.col("_whole")).withColumn("part", F.floor(F.col("_i") / part)).drop("_i", "_whole")


def packed_cells(cells: DataFrame, image: str, height: str = "height", width: str = "width") -> DataFrame:
    """One row an image, with its relevant cells (row, col) as arrays in order and its size; an image is bounded by its camera."""
    places = F.sort_array(F.collect_set(F.struct("row", "col")))
    packed = cells.groupBy(image).agg(places.alias("_p"), F.max(height).alias("height"), F.max(width).alias("width"))
    return packed.select(image, F.col("_p.row").cast("array<int>").alias("rows"), F.col("_p.col").cast("array<int>").alias("cols"), "height", "width")


def draw(free: np.ndarray, seed: int, image: str, patch: int) -> int:
    """The place of a free cell, by a hash of image and patch number."""
    at = np.flatnonzero(free)
    return int(at[int(hashlib.md5(f"{seed},{image},{patch}".encode()).hexdigest()[:12], 16) % len(at)])


def take(rows: np.ndarray, cols: np.ndarray, free: np.ndarray, at: int, shape: tuple[int, int], height: int, width: int) -> tuple[int, int]:
    """Top and left of the patch around a cell, moved inside the image; its cells are free no more."""
    top = int(min(max(rows[at] - height // 2, 0), max(shape[0] - height, 0)))
    left = int(min(max(cols[at] - width // 2, 0), max(shape[1] - width, 0)))
    free &= ~((rows >= top) & (rows < top + height) & (cols >= left) & (cols < left + width))
    return top, left


class UsedCells(StatefulProcessor):
    """State of an image: which of its cells no patch has held yet, and how many patches were drawn."""

    def __init__(self, image: str, height: int, width: int, seed: int):
        self.image, self.height, self.width, self.seed = image, height, width, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cells", T.StructType([T.StructField("free", T.BinaryType()), T.StructField("drawn", T.IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, cells = 0, None
        for pdf in rows:
            asked += int(pdf["patches"].sum())
            cells = pdf.iloc[0] if cells is None else cells
        r, c, shape = np.array(cells["rows"]), np.array(cells["cols"]), (int(cells["height"]), int(cells["width"]))
        free, n = np.ones(len(r), bool), 0
        if self.state.exists():
            bits, n = self.state.get()
            free = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(r)).astype(bool)
        out = []
        while asked > len(out) and free.any():
            top, left = take(r, c, free, draw(free, self.seed, str(key[0]), n), shape, self.height, self.width)
            out.append((key[0], n, top, left))
            n += 1
        self.state.update((np.packbits(free).tobytes(), n))
        yield pd.DataFrame(out, columns=[self.image, "patch", "top", "left"])

    def close(self) -> None:
        pass


def stateful_patches(requests: DataFrame, packed: DataFrame, image: str, height: int, width: int, seed: int = 0) -> DataFrame:
    """(image, patch, top, left) for a stream of ``requests`` (image, patches): as many new patches as asked for.

    A cell that a patch of the image held, in this batch or in any before, is drawn no more; an
    image without free cells gives nothing further.  The session's state store must be RocksDB's
    (``use_rocksdb``).  ``packed``: see ``packed_cells``.
    """
    kind = requests.schema[image].dataType.simpleString()
    rows = requests.select(image, "patches").join(packed, image)
    return rows.groupBy(image).transformWithStateInPandas(
        statefulProcessor=UsedCells(image, height, width, seed),
        outputStructType=f"{image} {kind}, patch int, top int, left int",
        outputMode="Append",
        timeMode="None",
    )


def all_patches(packed: DataFrame, image: str, height: int, width: int, most: Column | int | None = None, seed: int = 0) -> DataFrame:
    """The same patches of a table at rest: until no cell is free, or ``most`` of each image."""
    kind = packed.schema[image].dataType.simpleString()
    limit = F.lit(None).cast("int") if most is None else F.lit(most).cast("int") if isinstance(most, int) else most.cast("int")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for x in pdf.itertuples(index=False):
                r, c, n = np.array(x.rows), np.array(x.cols), 0
                free = np.ones(len(r), bool)
                while free.any() and (pd.isna(x.most) or n < x.most):
                    out.append((x.image, n, *take(r, c, free, draw(free, seed, str(x.image), n), (x.height, x.width), height, width)))
                    n += 1
            yield pd.DataFrame(out, columns=["image", "patch", "top", "left"])

    rows = packed.select(F.col(image).alias("image"), "rows", "cols", "height", "width", limit.alias("most"))
    return rows.mapInPandas(work, f"image {kind}, patch int, top int, left int").withColumnRenamed("image", image)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that processors with state of their own need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
