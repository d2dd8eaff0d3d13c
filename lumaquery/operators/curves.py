"""Bootstrapped ROC curves in one pass over the scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bootstrap import picks, places

CHUNK = 50
#: Draws that one task counts.
DRAWS = 1_000_000


def replicate_weights(df: DataFrame, unit: str, n: int, seed: int = 0) -> DataFrame:
    """(unit, bootstraps, counts): which of n bootstraps draw a unit, and how often; the draws are those of ``resampled``."""
    placed, units = places(df, [], unit)
    # one exchange by place: a place's draws are counted and packed in the same task, without their unit
    drawn = picks(placed, [], n, seed).select("_p", "bootstrap").repartition(-(-max(1, units * n) // DRAWS), "_p")
    counts = drawn.groupBy("_p", "bootstrap").agg(F.count("*").cast("double").alias("_k"))
    pairs = F.collect_list(F.struct(F.col("bootstrap").cast("int").alias("b"), "_k"))  # at most n of a unit
    packed = counts.groupBy("_p").agg(pairs.alias("_c"))
    return packed.join(placed.select(unit, "_p"), "_p").select(unit, F.col("_c.b").alias("bootstraps"), F.col("_c._k").alias("counts"))


def _summed(width: int, bins: int):
    """A task's sums of counts by bin and label, as rows (bin, positive, chunk, values)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * bins * width)
        for b in batches:
            at = 2 * b.column("bin").to_numpy() + b.column("positive").to_numpy()
            drawn, counts = b.column("bootstraps"), b.column("counts")
            each = np.repeat(at, drawn.value_lengths().to_numpy())
            np.add.at(total, each.astype(np.int64) * width + drawn.flatten().to_numpy(), counts.flatten().to_numpy())
        table = total.reshape(2 * bins, width)
        rows = [(i // 2, i % 2, c // CHUNK, table[i, c : c + CHUNK].tolist()) for i in np.flatnonzero(table.any(1)).tolist() for c in range(0, width, CHUNK)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bin", "positive", "chunk", "values"])

    return work


def bootstrapped_roc(scores: DataFrame, unit: str, score: str, label: str, n: int, steps: int = 500, seed: int = 0) -> DataFrame:
    """(bootstrap, threshold, tpr, fpr) at ``steps`` even thresholds from 0 to 1 for each of n bootstraps of units.

    Scores are read once: a row adds its unit's counts, an array over the bootstraps, to its bin (the
    last threshold it reaches), so no row is copied for a bootstrap.  The sums, bins times bootstraps, are
    then added up from above.  Rows with a null score or label are left out; a rate without cases is null.
    """
    weights = replicate_weights(scores, unit, n, seed)
    s = F.col(score).cast("double")
    known = scores.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull() & F.col(unit).isNotNull())
    # bin 0: below all thresholds; bin k: reaches thresholds 0 .. k - 1, as in ``metrics.roc``
    place = F.greatest(F.lit(-1), F.least(F.floor(s * (steps - 1) + 1e-9), F.lit(steps - 1))) + 1
    rows = known.join(weights, unit).select(place.cast("int").alias("bin"), F.col(label).cast("int").alias("positive"), "bootstraps", "counts")
    partial = rows.mapInArrow(_summed(n, steps + 1), "bin int, positive int, chunk int, values array<double>")
    sums = partial.groupBy("bin", "positive", "chunk").agg(F.array(*[F.sum(F.coalesce(F.get("values", F.lit(j)), F.lit(0.0))) for j in range(min(CHUNK, n))]).alias("values"))
    each = sums.select("bin", "positive", "chunk", F.posexplode("values").alias("j", "w")).select("bin", "positive", (F.col("chunk") * CHUNK + F.col("j")).alias("bootstrap"), "w").where(F.col("bootstrap") < n)
    pairs = each.groupBy("bootstrap", "bin").agg(F.sum(F.when(F.col("positive") == 1, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("positive") == 0, F.col("w")).otherwise(0.0)).alias("q"))
    grid = scores.sparkSession.range(n).select(F.col("id").cast("int").alias("bootstrap"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("bin"))
    full = grid.join(pairs, ["bootstrap", "bin"], "left").na.fill(0.0, ["p", "q"])
    down = Window.partitionBy("bootstrap").orderBy(F.desc("bin"))  # steps + 1 rows
    reached = full.select("bootstrap", "bin", F.sum("p").over(down).alias("p"), F.sum("q").over(down).alias("q"), F.sum("p").over(Window.partitionBy("bootstrap")).alias("ps"), F.sum("q").over(Window.partitionBy("bootstrap")).alias("qs"))
    rate = lambda x, y: F.try_divide(F.col(x), F.col(y))
    return reached.where("bin > 0").select("bootstrap", ((F.col("bin") - 1) / (steps - 1)).alias("threshold"), rate("p", "ps").alias("tpr"), rate("q", "qs").alias("fpr"))


def areas(curves: DataFrame) -> DataFrame:
    """(bootstrap, auc): the area under each curve by trapezoids, with its ends (0, 0) and (1, 1)."""
    ends = curves.select("bootstrap").distinct().select("bootstrap", F.explode(F.array(F.struct(F.lit(-1.0).alias("t"), F.lit(1.0).alias("r")), F.struct(F.lit(2.0).alias("t"), F.lit(0.0).alias("r")))).alias("e"))
    points = curves.select("bootstrap", "threshold", "tpr", "fpr").unionAll(ends.select("bootstrap", "e.t", "e.r", "e.r"))
    w = Window.partitionBy("bootstrap").orderBy("threshold")
    strip = (F.col("fpr") - F.lead("fpr").over(w)) * (F.col("tpr") + F.lead("tpr").over(w)) / 2
    return points.withColumn("_s", strip).groupBy("bootstrap").agg(F.sum("_s").alias("auc"))


def summary(curves: DataFrame) -> DataFrame:
    """Mean and 2.5 and 97.5 per cent bounds of the true positive rate at each threshold."""
    rate = F.col("tpr")
    return curves.groupBy("threshold").agg(F.avg(rate).alias("mean"), F.percentile(rate, F.lit(0.025)).alias("low"), F.percentile(rate, F.lit(0.975)).alias("high"))
