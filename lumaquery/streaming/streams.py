"""Streams: running statistics, epoch logs, windows on event time, and sample batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bootstrap import numbered, uniform


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_statistics(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and population deviation so far; for update or complete mode."""
    return stream.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def windowed(stream: DataFrame, at: str, length: str, keys: list[str], value: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows with a watermark."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))


def append_log(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Each batch is written below its number, so a repeated batch replaces itself; the running query."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sample_batches(df: DataFrame, size: int, epochs: int = 1, seed: int = 0, id_col: str = "image_name") -> DataFrame:
    """Rows with ``epoch`` and ``batch``: every epoch all rows in another random order, in batches of
    ``size``; an epoch's last may be smaller."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    out = numbered(rows, uniform(seed, F.col("epoch"), F.col(id_col)), [id_col], "_i", ["epoch"])
    return out.withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")


def worker_share(df: DataFrame, workers: int, strided: bool = True, id_col: str = "image_name", seed: int = 0) -> DataFrame:
    """Rows with the worker that gets them: every n-th of a random order, or runs of equal length of it."""
    out = numbered(df, uniform(seed, F.col(id_col)), [id_col], "_i")
    n = out.agg(F.count("*")).scalar()
    worker = F.pmod(F.col("_i"), F.lit(workers)) if strided else F.floor(F.col("_i") * workers / n)
    return out.withColumn("worker", worker.cast("int")).drop("_i")


def patch_places(images: DataFrame, image: str, rows: str, cols: str, height: int, width: int, n: int, proportional: bool = True, seed: int = 0) -> DataFrame:
    """(image, patch, top, left): ``n`` patches from all images, as many from each in proportion to the
    places that it has, or equally many; the places are drawn with replacement."""
    places = F.greatest(F.col(rows) - height + 1, F.lit(0)) * F.greatest(F.col(cols) - width + 1, F.lit(0))
    fits = images.select(image, rows, cols, places.cast("double").alias("_w")).where("_w > 0")
    sums = fits.agg(F.sum("_w"), F.count("*")).first()
    share = F.col("_w") / (sums[0] or 1.0) if proportional else F.lit(1.0 / max(1, sums[1]))
    many = fits.withColumn("_n", F.floor(share * n + uniform(seed, F.col(image), F.lit("n"))).cast("int")).where("_n > 0")
    drawn = many.withColumn("patch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda size, length, name: F.floor(uniform(seed, F.col(image), F.col("patch"), F.lit(name)) * (F.col(size) - length + 1)).cast("int")
    return drawn.select(image, "patch", at(rows, height, "r").alias("top"), at(cols, width, "c").alias("left"))


def patches(cells: DataFrame, image: str, height: int, width: int, n: int, seed: int = 0) -> DataFrame:
    """n patches an image around drawn cells; a cell that a patch holds is drawn no more.

    The used cells are one image's state, so an image is drawn in one task.
    """
    import numpy as np
    import pandas as pd

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, *map(ord, str(pdf[image].iloc[0]))])
        rows, cols, free, out = pdf["row"].to_numpy(), pdf["col"].to_numpy(), np.ones(len(pdf), bool), []
        for k in range(n):
            if not free.any():
                break
            at = rng.choice(np.flatnonzero(free))
            top = int(min(max(rows[at] - height // 2, 0), max(rows.max() - height + 1, 0)))
            left = int(min(max(cols[at] - width // 2, 0), max(cols.max() - width + 1, 0)))
            free &= ~((rows >= top) & (rows < top + height) & (cols >= left) & (cols < left + width))
            out.append((pdf[image].iloc[0], k, top, left))
        return pd.DataFrame(out, columns=[image, "patch", "top", "left"])

    kind = cells.schema[image].dataType.simpleString()
    return cells.select(image, "row", "col").groupBy(image).applyInPandas(work, f"{image} {kind}, patch int, top int, left int")
