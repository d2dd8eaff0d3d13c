"""Distances between the borders of label regions, by an exact distance transform."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def border(mask: np.ndarray) -> np.ndarray:
    """Cells of a mask with a neighbour (of four) outside it or at the image's edge, as a mask."""
    padded = np.pad(mask, 1)
    inner = padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    return mask & ~inner


def squared_distances(points: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every cell to the nearest true cell, exactly; infinite without one.

    Distances along columns come from running maxima.  Along a row each column is a parabola
    (x - column) ** 2 + its distance squared; the lower envelope of a row's parabolas is built from left
    to right, all rows at once, and then read from left to right.  Work is linear in the cells.
    """
    height, width = points.shape
    out = np.full(points.shape, np.inf)
    columns = np.flatnonzero(points.any(0))
    if not len(columns):
        return out
    rows, far = np.arange(height), 4 * (height + width)
    at = rows[:, None]
    above = np.maximum.accumulate(np.where(points, at, -far), axis=0)
    below = np.minimum.accumulate(np.where(points, at, far)[::-1], axis=0)[::-1]
    high = np.minimum(at - above, below - at).astype(float) ** 2
    # a row's envelope: which columns, where each begins to be the lowest, and how many there are
    which, begins, top = np.zeros((height, len(columns)), int), np.full((height, len(columns) + 1), np.inf), np.zeros(height, int)
    which[:, 0], begins[:, 0] = columns[0], -np.inf
    for q in columns[1:]:
        todo, cut = rows, np.empty(height)
        while len(todo):
            v = which[todo, top[todo]]
            cut[todo] = (high[todo, q] + q * q - high[todo, v] - v * v) / (2 * (q - v))
            todo = todo[cut[todo] <= begins[todo, top[todo]]]
            top[todo] -= 1
        top += 1
        which[rows, top], begins[rows, top], begins[rows, top + 1] = q, cut, np.inf
    now = np.zeros(height, int)
    for x in range(width):
        todo = rows
        while len(todo := todo[begins[todo, now[todo] + 1] < x]):
            now[todo] += 1
        v = which[rows, now]
        out[:, x] = (x - v) ** 2 + high[rows, v]
    return out


def both_ways(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each cell of mask a to mask b and of each of b to a."""
    return np.sqrt(np.concatenate([squared_distances(b)[a], squared_distances(a)[b]]))


def surface_scores(cells: DataFrame, image: str = "image_name", tolerance: float | dict[int, float] | list[float] = 1.0) -> DataFrame:
    """Normalised surface dice and mean surface distance of each label of each image.

    One image's cells (row, col, label, prediction, valid) are one task's arrays; an
    image is bounded by its camera.  ``tolerance`` is one number, or a number for each label (by
    label, or a list by the label's number); a label that has none is an error.  Distances that
    don't exist count as the largest finite one of the image, or its diagonal if there is none.
    """
    of = (lambda c: tolerance) if isinstance(tolerance, (int, float)) else (lambda c: tolerance[c])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1)
        grids = {}
        for c in ("label", "prediction"):
            g = np.full(shape, -1)
            v = pdf[pdf["valid"]]
            g[v["row"], v["col"]] = v[c]
            grids[c] = g
        found = []
        for c in sorted(set(pdf.loc[pdf["valid"], "label"])):
            a, b = (border(grids[k] == c) for k in ("label", "prediction"))
            found.append((int(c), both_ways(a, b)))
        finite = [d[np.isfinite(d)].max() for _, d in found if np.isfinite(d).any()]
        worst = max(finite) if finite else float(np.hypot(*shape))
        rows = [(pdf[image].iloc[0], c, float((d <= of(c)).mean()), float(np.where(np.isfinite(d), d, worst).mean())) for c, d in found]
        return pd.DataFrame(rows, columns=[image, "label", "nsd", "asd"])

    kind = cells.schema[image].dataType.simpleString()
    return cells.select(image, "row", "col", "label", "prediction", "valid").groupBy(image).applyInPandas(work, f"{image} {kind}, label int, nsd double, asd double")


def border_distances(cells: DataFrame, image: str = "image_name") -> DataFrame:
    """Distances between the borders that two annotators (label, prediction) drew, both ways, finite ones only."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1)
        a, b = np.full(shape, -1), np.full(shape, -1)
        a[pdf["row"], pdf["col"]], b[pdf["row"], pdf["col"]] = pdf["label"], pdf["prediction"]
        rows = []
        for c in sorted(set(pdf["label"]) & set(pdf["prediction"])):
            d = both_ways(border(a == c), border(b == c))
            rows += [(pdf[image].iloc[0], int(c), float(x)) for x in d[np.isfinite(d)]]
        return pd.DataFrame(rows, columns=[image, "label", "distance"])

    kind = cells.schema[image].dataType.simpleString()
    return cells.groupBy(image).applyInPandas(work, f"{image} {kind}, label int, distance double")


def tolerances(distances: DataFrame, how: str = "mean") -> dict[int, float]:
    """A tolerance for each label from annotators' ``distances`` (label, distance): their mean, or a quantile as ``'q=0.95'``."""
    value = F.avg("distance") if how == "mean" else F.percentile("distance", F.lit(float(how.removeprefix("q="))))
    return {r.label: r.t for r in distances.groupBy("label").agg(value.alias("t")).collect()}  # a row a label
