"""Connected components: in one task's arrays, and over a whole table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def connected_components(spark: SparkSession, scratch: Scratch, links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node in ``links`` (src, dst).

    Each round takes the smallest label among neighbours, then follows labels to
    their labels; it ends when a round changes nothing, which the sum of labels
    shows.  Rounds are written tables, so a lost executor costs one round at most.
    """
    both = links.where("src <> dst")
    both = scratch.write(both.select("src", "dst").unionAll(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    labels = scratch.write(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("label")))
    total = _sum(labels)
    while total is not None:
        near = both.join(labels, both.dst == labels.node).select(F.col("src").alias("node"), "label")
        hooked = scratch.write(labels.unionAll(near).groupBy("node").agg(F.min("label").alias("label")))
        now = _sum(hooked)
        if now == total:
            break
        ahead = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = scratch.write(hooked.join(ahead, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        scratch.drop(labels)
        scratch.drop(hooked)
        labels, total = jumped, _sum(jumped)
    return labels.select("node", F.col("label").alias("component"))


def _sum(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
