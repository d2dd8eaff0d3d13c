"""Confusion matrices, overlap, calibration and probability scores over long rows.

Cells are rows (image, label, prediction, valid); what counts in a table of
millions of cells is counted before anything is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dependence import distance_correlation  # noqa: F401
from .surfaces import border_distances, surface_scores  # noqa: F401


def confusion(cells: DataFrame, keys: list[str], n_classes: int, label: str = "label", prediction: str = "prediction", valid: str | None = None) -> DataFrame:
    """Dense counts (keys, i, j, n): reference i, prediction j; zeros for what never occurs."""
    if valid:
        cells = cells.where(valid)
    found = cells.groupBy(*keys, F.col(label).cast("int").alias("i"), F.col(prediction).cast("int").alias("j")).agg(F.count("*").alias("n"))
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    groups = found.select(*keys).distinct() if keys else found.sparkSession.range(1).select()
    grid = groups.select(*keys, F.explode(classes).alias("i")).select(*keys, "i", F.explode(classes).alias("j"))
    return grid.join(found, [*keys, "i", "j"], "left").select(*keys, "i", "j", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def dice_from_confusion(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Dice of every class with reference cells: 2 tp / (2 tp + fp + fn)."""
    both = counts.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("c"), F.lit(True).alias("r")), F.struct(F.col("j").alias("c"), F.lit(False).alias("r")))).alias("x"), "i", "j", "n")
    sums = both.groupBy(*keys, F.col("x.c").alias("label")).agg(
        F.sum(F.when(F.col("x.r"), F.col("n")).otherwise(0)).alias("reference"),
        F.sum(F.when(~F.col("x.r"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("x.r") & (F.col("i") == F.col("j")), F.col("n")).otherwise(0)).alias("hit"),
    )
    return sums.where("reference > 0").select(*keys, "label", (2 * F.col("hit") / (F.col("reference") + F.col("predicted"))).alias("dice"))


def accuracy_from_confusion(counts: DataFrame, keys: list[str]) -> DataFrame:
    right = F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0))
    return counts.groupBy(*keys).agg((right / F.sum("n")).alias("accuracy"))


def normalised_confusion(counts: DataFrame, group: str) -> DataFrame:
    """Rows of each group's matrix as shares; their mean and deviation over groups that have the row."""
    share = counts.withColumn("_t", F.sum("n").over(Window.partitionBy(group, "i"))).where("_t > 0").withColumn("_s", F.col("n") / F.col("_t"))
    return share.groupBy("i", "j").agg(F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("std"))


def samples_from_confusion(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A (label, prediction) row for each count."""
    return counts.where("n > 0").select(*keys, F.col("i").alias("label"), F.col("j").alias("prediction"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_k")).drop("_k")


def bin_right_closed(confidence: Column, bins: int) -> Column:
    """Bin of (b, b + 1/bins]; a value on an edge belongs to the lower bin."""
    out = F.lit(bins - 1)
    for b in range(bins - 2, -1, -1):
        out = F.when(confidence <= (b + 1) / bins, F.lit(b)).otherwise(out)
    return out


def calibration_bins(rows: DataFrame, keys: list[str], bins: int, confidence: str, correct: Column) -> DataFrame:
    """(keys, bin, n, hits, confidence) sums, which add up over images."""
    return rows.groupBy(*keys, bin_right_closed(F.col(confidence), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(correct.cast("double")).alias("hits"), F.sum(confidence).alias("confidence"))


def calibration_error(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error from summed bins."""
    sums = binned.groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "confidence")])
    gap = F.abs(F.col("hits") - F.col("confidence"))  # n |hits / n - confidence / n|
    return sums.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("error"))


def brier(p: Column, label: Column) -> Column:
    """Squared distance of probabilities from the one-hot label; for two classes that of class 1 alone."""
    many = F.aggregate(F.transform(p, lambda x, i: F.pow(x - (i == label).cast("double"), 2.0)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(p) == 2, F.pow(F.get(p, F.lit(1)) - label.cast("double"), 2.0)).otherwise(many)


def dice_at_thresholds(cells: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """(keys, threshold, label, area, dice) for cells whose confidence reaches the threshold.

    The area is the share of all the label's reference cells, valid or not; a
    label that is gone has area 0 and a dice of NaN.
    """
    cells = cells.withColumn("_t", F.explode(F.array(*map(F.lit, thresholds))))
    kept = F.col("valid") & (F.col("confidence") >= F.col("_t"))
    sides = F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("r")), F.struct(F.col("prediction").alias("c"), F.lit(0).alias("r")))
    long = cells.select(*keys, "_t", kept.alias("_k"), (F.col("label") == F.col("prediction")).alias("_hit"), F.explode(sides).alias("x"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    reference = F.col("x.r") == 1
    sums = long.groupBy(*keys, "_t", F.col("x.c").alias("label")).agg(one(reference).alias("all"), one(reference & F.col("_k")).alias("ref"), one(~reference & F.col("_k")).alias("pred"), one(reference & F.col("_k") & F.col("_hit")).alias("hit"))
    dice = F.when(F.col("ref") > 0, 2 * F.col("hit") / (F.col("ref") + F.col("pred"))).otherwise(F.lit(float("nan")))
    return sums.where(F.col("all") > 0).select(*keys, F.col("_t").alias("threshold"), "label", (F.col("ref") / F.col("all")).alias("area"), dice.alias("dice"))


def roc(scores: DataFrame, keys: list[str], score: str, label: str, steps: int = 500) -> DataFrame:
    """Rates at evenly spaced thresholds from 0 to 1 (score >= threshold).

    A score below 0 counts as reaching no threshold, one above 1 as reaching all; rows
    with a score that is null or NaN are left out.  Scores are first counted by the last threshold they reach, so thresholds times
    rows never arise.
    """
    known = scores.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    place = F.greatest(F.lit(-1), F.least(F.floor(F.col(score).cast("double") * (steps - 1) + 1e-9), F.lit(steps - 1)))
    bins = known.groupBy(*keys, place.cast("int").alias("_b")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    grid = bins.select(*keys).distinct() if keys else scores.sparkSession.range(1).select()
    grid = grid.withColumn("_b", F.explode(F.sequence(F.lit(-1), F.lit(steps - 1))))
    full = grid.join(bins, [*keys, "_b"], "left").na.fill(0, ["p", "n"])
    back = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    out = full.select(*keys, (F.col("_b") / (steps - 1)).alias("threshold"), F.sum("p").over(back).alias("tp"), F.sum(F.col("n") - F.col("p")).over(back).alias("fp"), F.sum("p").over(every).alias("positives"), F.sum(F.col("n") - F.col("p")).over(every).alias("negatives"))
    return out.where("threshold >= 0").select(*keys, "threshold", F.try_divide("tp", "positives").alias("tpr"), F.try_divide("fp", "negatives").alias("fpr"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def _ranked(scores: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Positives ``p`` and negatives ``q`` of every distinct score, those of smaller scores
    (``p_below``, ``q_below``) and of all scores (``p_all``, ``q_all``).

    Running sums go over bins of the scores first and then within a bin, so that no task
    orders all scores of a group.  NaN counts as the largest score and null as the smallest.
    """
    positive = F.col(label).cast("long")
    counts = scores.groupBy(*keys, score).agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("q"))
    place = F.when(F.isnan(F.col(score).cast("double")), F.lit(2**63 - 1)).otherwise(F.floor(F.col(score).cast("double") * 1024))
    counts = counts.withColumn("_bin", place)
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    sums = [F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_bins") for c in "pq"]
    sums += [F.sum(f"_{c}").over(Window.partitionBy(*keys)).alias(f"{c}_all") for c in "pq"]
    bins = bins.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_bin").alias("_b"), *sums)
    same = F.col("_bin").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    within = Window.partitionBy(*keys, "_bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = [(F.col(f"_{c}_bins") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_below") for c in "pq"]
    return counts.join(bins, same).select(*keys, score, "p", "q", "p_all", "q_all", *below)


def auroc(scores: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Exact area under the curve by ranks of the distinct scores, ties halved."""
    pairs = _ranked(scores, keys, score, label).withColumn("_w", F.col("p") * (F.col("q_below") + F.col("q") / 2))
    return pairs.groupBy(*keys).agg(F.try_divide(F.sum("_w"), F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def average_precision(scores: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the precision-recall steps: the precision at each distinct score, weighted by the
    recall gained there.  Null where a group has no positive."""
    reached, hits = F.col("p_all") - F.col("p_below"), F.col("p_all") + F.col("q_all") - F.col("p_below") - F.col("q_below")
    steps = _ranked(scores, keys, score, label).withColumn("_w", F.col("p") * reached / hits)
    return steps.groupBy(*keys).agg(F.try_divide(F.sum("_w"), F.sum("p")).alias("average_precision"))


def superpixels(cells: DataFrame, keys: list[str], superpixel: str, label: str, valid: Column) -> DataFrame:
    """Most frequent valid label of each superpixel (the lowest of equal ones), 0 for one without valid cells."""
    from .aggregates import most_common

    found = most_common(cells.where(valid), [*keys, superpixel], label)
    return cells.select(*keys, superpixel).distinct().join(found, [*keys, superpixel], "left").na.fill(0, [label, "n"])


def gini(rows: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Gini impurity of the mean probability vector of a group."""
    from ..functions.arrays import elementwise, total

    return elementwise(rows, keys, p).select(*keys, (1 - total(F.transform(p, lambda x: x * x))).alias("gini"))


def annotator_pairs(cells: DataFrame, image: str = "image_name", annotator: str = "annotation_name") -> DataFrame:
    """Cells that two annotators of an image have both marked: (image, first, second, row, col, label, prediction)."""
    place = [image, "row", "col"]
    a = cells.select(*place, F.col(annotator).alias("first"), "label")
    b = cells.select(*place, F.col(annotator).alias("second"), F.col("label").alias("prediction"))
    return a.join(b, place).where(F.col("first") < F.col("second")).select(image, "first", "second", "row", "col", "label", "prediction")


def curve_on_grid(df: DataFrame, keys: list[str], x: str, y: str, low: float, high: float, points: int = 100) -> DataFrame:
    """Curves on a common grid by linear interpolation, NaN outside; a single point goes to the nearest grid point."""
    grid = np.linspace(low, high, points)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(x)
        if len(p) == 1:
            out = np.full(points, np.nan)
            out[np.abs(grid - p[x].iloc[0]).argmin()] = p[y].iloc[0]
        else:
            out = np.interp(grid, p[x], p[y], left=np.nan, right=np.nan)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "at": np.arange(points), x: grid, y: out})

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(work, f"{kinds}, at int, {x} double, {y} double")


def discriminant(df: DataFrame, label: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and directions of linear discriminant analysis.

    Spark sums vectors and products by class (width squared numbers); only these
    sums reach the driver.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(label).alias("c"), v.alias("v"))
    sums = {r.c: (r.n, np.array(r.m)) for r in _sums(rows, "c").collect()}
    d = len(next(iter(sums.values()))[1])
    s2 = np.zeros((d, d))
    # products are added up in each partition: a row for each line of the matrix leaves it
    lines = rows.select("v").mapInArrow(_products, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "x"))
    for r in lines.groupBy("i", "j").agg(F.sum("x").alias("s")).collect():
        s2[r.i, r.j] = r.s
    n, mean = sum(x[0] for x in sums.values()), sum(x[0] * x[1] for x in sums.values()) / sum(x[0] for x in sums.values())
    between = sum(k * np.outer(m - mean, m - mean) for k, m in sums.values())
    within = s2 - n * np.outer(mean, mean) - between
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    order = np.argsort(-values.real)
    return values.real[order], vectors.real[:, order]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        if b.num_rows:
            x = np.stack(b.column("v").to_numpy(zero_copy_only=False))
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "line"])


def _sums(rows: DataFrame, key: str) -> DataFrame:
    from ..functions.arrays import elementwise

    return elementwise(rows, [key], "v").withColumnRenamed("v", "m").join(rows.groupBy(key).agg(F.count("*").alias("n")), key)


def predicted(cells: DataFrame, probabilities: str, n_classes: int) -> DataFrame:
    """Cells with ``prediction`` (the class of the largest probability, the first of equal ones) and ``confidence``.

    Vectors with non-finite values are repaired and made probabilities again; one of another length
    than ``n_classes``, or whose sum is not 1 within 1e-5 (such as logits), is an error.
    """
    from ..functions import arrays as V
    from .composites import repaired_softmax

    p = repaired_softmax(F.col(probabilities).cast("array<double>"))
    fine = (F.size("_p") == n_classes) & (F.abs(V.total(F.col("_p")) - 1) <= 1e-5)
    checked = F.when(fine, F.col("_p")).otherwise(F.raise_error(F.lit("values of a cell are no probabilities of the classes")).cast("array<double>"))
    out = cells.drop("prediction", "confidence").withColumn("_p", p).withColumn("_p", checked)
    return out.withColumns({"prediction": V.argmax(F.col("_p")), "confidence": F.array_max("_p")}).drop("_p")


def evaluate_images(
    cells: DataFrame,
    image: str,
    n_classes: int,
    confidence: str | None = None,
    bins: int = 10,
    tolerance: float | dict[int, float] | list[float] | None = None,
    probabilities: str | None = None,
    thresholds: list[float] | None = None,
) -> DataFrame:
    """One row an image: ``accuracy``, ``dice`` by label (a map), their mean, ``confusion`` (rows of the
    matrix), with ``confidence`` the calibration ``error``, with ``tolerance`` (of all labels or by label) the
    surface dice by label, its mean, and the mean surface distance by label.

    Cells (image, label, prediction, valid, and row and col for surfaces) that are not valid
    take no part; an image without a valid cell is an error.  With ``probabilities`` (a column of vectors
    over the classes) predictions and confidences come from them.  With ``thresholds`` the map
    ``dice_confidences`` holds for each threshold the labels' area and dice among cells that reach it.
    """
    if probabilities:
        cells, confidence = predicted(cells, probabilities, n_classes), "confidence"
    by_label = lambda value: F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", value))))
    any_valid = F.when(F.bool_or("valid"), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no valid cell in image"), F.col(image).cast("string"))).cast("boolean"))
    images = cells.groupBy(image).agg(any_valid.alias("_ok")).where("_ok").select(image)
    counts = confusion(cells, [image], n_classes, valid="valid")
    dice = dice_from_confusion(counts, [image]).groupBy(image).agg(by_label("dice").alias("dice"), F.avg("dice").alias("dice_mean"))
    lines = counts.groupBy(image, "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "n"))), lambda s: s["n"]).alias("_row"))
    matrix = lines.groupBy(image).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "_row"))), lambda s: s["_row"]).alias("confusion"))
    # left joins: an image without a valid cell is an error, not an absence
    out = images.join(accuracy_from_confusion(counts, [image]), image, "left").join(dice, image, "left").join(matrix, image, "left")
    if confidence:
        binned = calibration_bins(cells.where("valid"), [image], bins, confidence, F.col("label") == F.col("prediction"))
        out = out.join(calibration_error(binned, [image]), image, "left")
    if tolerance is not None:
        surface = surface_scores(cells, image, tolerance).groupBy(image)
        out = out.join(surface.agg(by_label("nsd").alias("surface_dice"), F.avg("nsd").alias("surface_dice_mean"), by_label("asd").alias("surface_distance")), image, "left")
    if thresholds:
        each = dice_at_thresholds(cells.withColumn("confidence", F.col(confidence or "confidence")), [image], thresholds)
        each = each.groupBy(image, "threshold").agg(F.sort_array(F.collect_list(F.struct("label", "area", "dice"))).alias("_labels"))
        out = out.join(each.groupBy(image).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("threshold", "_labels")))).alias("dice_confidences")), image, "left")
    return out


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Rows of each partition with a running ``batch`` number, for a trainer that reads by partition
    (``foreachPartition``, or files written by it); nothing passes the driver."""
    numbered = rows.withColumn("_m", F.monotonically_increasing_id())
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(*rows.columns, F.shiftright("_m", 33).alias("part"), F.floor(place / size).alias("batch"))
