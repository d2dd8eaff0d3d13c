"""Recursive feature elimination: forests are trained anew in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def importances(df: DataFrame, label: str, features: list[str], fold: str, trees: int = 20, depth: int = 5, seed: int = 0) -> dict[str, float]:
    """The mean importance of each feature over forests that leave out one fold each."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = sorted(r[0] for r in df.select(fold).distinct().collect())  # some few folds
    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(df.select(F.col(label).cast("double").alias("_label"), F.col(fold).alias("_fold"), *features))
    total = dict.fromkeys(features, 0.0)
    for name in names:
        forest = RandomForestClassifier(labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed)
        for f, x in zip(features, forest.fit(rows.where(F.col("_fold") != name)).featureImportances.toArray(), strict=True):
            total[f] += float(x) / len(names)
    return total


def recursive_elimination(df: DataFrame, label: str, features: list[str], fold: str, keep: int = 1, **forest) -> DataFrame:
    """(round, feature, importance): the feature that each round drops, the one of least mean importance (of equal ones
    the first by name), until ``keep`` are left; these have the round after the last."""
    left, rows = sorted(features), []
    while len(left) > keep:
        found = importances(df, label, left, fold, **forest)
        worst = min(left, key=lambda f: (found[f], f))
        rows.append((len(rows), worst, found[worst]))
        left.remove(worst)
    if left:
        found = importances(df, label, left, fold, **forest)
        rows += [(len(features) - len(left), f, found[f]) for f in left]
    return df.sparkSession.createDataFrame(rows, "round int, feature string, importance double")
