"""Composite queries: cohorts, ensembles, comparisons of runs, and lookups with fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as V
from . import aggregates as A


# -- lookups ---------------------------------------------------------------------------------------


def lookup(keys: DataFrame, sources: list[DataFrame], key: str, column: str) -> DataFrame:
    """``column`` of each key from the first source that has it."""
    out = keys
    for i, s in enumerate(sources):
        out = out.join(s.groupBy(key).agg(F.any_value(column, True).alias(f"_v{i}")), key, "left")
    found = F.coalesce(*[F.col(f"_v{i}") for i in range(len(sources))])
    return out.withColumn(column, found).drop(*[f"_v{i}" for i in range(len(sources))])


def follow_links(paths: DataFrame, links: DataFrame, column: str = "path") -> DataFrame:
    """Paths and those that links (from, to) lead to from them."""
    more = paths.join(links, F.col(column) == F.col("from")).select(F.col("to").alias(column))
    return paths.select(column).unionAll(more).distinct()


def has_labels(labels: Column, least: int) -> Column:
    """Image filter: at least so many labels."""
    return F.coalesce(F.size(labels) >= least, F.lit(False))


def has_any_label(labels: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, wanted))), F.lit(False))


def in_situ(meta: Column) -> Column:
    """Image filter over a map of annotation metadata: in situ unless some entry says otherwise."""
    return F.coalesce(~F.exists(F.map_values(meta), lambda x: ~x), F.lit(True))


# -- cohorts ---------------------------------------------------------------------------------------


def first_inclusion(df: DataFrame, subject: str, at: str, status: str) -> DataFrame:
    """Rows of each subject's first date among rows with a known status."""
    from .timeline import first_dates

    return first_dates(df.where(F.col(status).isNotNull()), [subject], at)


def without_overlap(df: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows whose keys no other cohort has."""
    return reduce(lambda a, b: a.join(b.select(*keys).distinct(), keys, "left_anti"), others, df)


def baseline_difference(df: DataFrame, subject: str, label: str, phase: str, base: str, value: str) -> DataFrame:
    """Difference to the subject's mean in the base phase, else to that of all subjects."""
    from .joins import fallback

    rows = df.where(F.col(phase) == base)
    exact = rows.groupBy(subject, label).agg(F.avg(value).alias("baseline"))
    general = rows.groupBy(label).agg(F.avg(value).alias("baseline"))
    out = fallback(df, exact, general, [subject, label], [label], "baseline")
    return out.withColumn("difference", F.col(value) - F.col("baseline"))


def perfusion_state(df: DataFrame, phase: str, states: dict[str, str], name: str = "perfusion_state", clear: Column | None = None) -> DataFrame:
    """Phases mapped to states; rows that ``clear`` marks become null.  A null mark is not set."""
    flat = [x for k, v in states.items() for x in (F.lit(k), F.lit(v))]
    state = F.try_element_at(F.create_map(*flat), F.col(phase))
    return df.withColumn(name, state if clear is None else F.when(~F.coalesce(clear, F.lit(False)), state))


# -- result tables ---------------------------------------------------------------------------------


def aggregated_table(df: DataFrame, metrics: list[str], domains: list[str] = ()) -> DataFrame:
    """Class-level means of a test table with all its metrics."""
    return A.grouped_metrics(df, metrics, domains=list(domains))


def confidences_table(df: DataFrame, keys: list[str], confidences: str) -> DataFrame:
    """One row a (key, threshold, label) of a map threshold -> (areas, dice_metric) beside ``used_labels``."""
    long = df.select(*keys, "used_labels", F.explode(confidences).alias("threshold", "c"))
    return long.select(*keys, "threshold", F.inline(F.arrays_zip("used_labels", F.col("c.areas").alias("area"), F.col("c.dice_metric").alias("dice"))))


def comparison_table(runs: dict[str, DataFrame], keys: list[str], metric: str) -> DataFrame:
    """One column a run of its mean metric by keys."""
    long = reduce(DataFrame.unionByName, [d.select(*keys, F.col(metric).alias("_m")).withColumn("_run", F.lit(n)) for n, d in runs.items()])
    return long.groupBy(*keys).pivot("_run", list(runs)).agg(F.avg("_m"))


def challenge_table(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metrics as (keys, task, value), no row without a value."""
    return df.unpivot(keys, metrics, "task", "value").where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))


def size_table(df: DataFrame, metrics: list[str], fold: str = "fold_name") -> DataFrame:
    """Means by the number of subjects and the seed that a fold's name tells (``fold_n=3_seed=1``)."""
    out = A.grouped_metrics(df, metrics, domains=[fold])
    number = lambda what: F.regexp_extract(fold, what + r"=(\d+)", 1).cast("int")
    return out.withColumn("size", number("n")).withColumn("seed", number("seed"))


def consistency(results: DataFrame, keys: list[str], image: str = "image_name") -> DataFrame:
    """Violations of a result table: repeated images, epochs of unequal size, folds without their best epoch."""
    from .checks import _violations, repeated_keys

    epochs = [c for c in ("fold_name", "epoch_index", "dataset_index") if c in results.columns]
    found = repeated_keys(results, [*keys, *epochs, image])
    if "epoch_index" in results.columns:
        counts = results.groupBy(*epochs).agg(F.count("*").alias("_n"))
        other = [c for c in epochs if c != "epoch_index"]
        spread = counts.groupBy(*other).agg((F.max("_n") != F.min("_n")).alias("_bad")).where("_bad")
        found = found.unionAll(_violations(spread, other, "epochs of unequal size"))
    if "best_epoch_index" in results.columns:
        best = results.groupBy("fold_name").agg(F.bool_or(F.col("epoch_index") == F.col("best_epoch_index")).alias("_has")).where("not _has")
        found = found.unionAll(_violations(best, ["fold_name"], "best epoch missing"))
    return found


# -- classification and ensembles ------------------------------------------------------------------


def ensemble(df: DataFrame, keys: list[str], logits: str, how: str = "logits") -> DataFrame:
    """Prediction of several runs a key: from the mean of logits, of softmax values, or the most frequent class."""
    if how == "mode":
        return A.most_common(df.withColumn("prediction", V.argmax(F.col(logits))), keys, "prediction").drop("n")
    rows = df.withColumn(logits, V.softmax(F.col(logits))) if how == "softmax" else df
    return V.elementwise(rows, keys, logits).withColumn("prediction", V.argmax(F.col(logits)))


def subject_accuracy(df: DataFrame, subject: str, label: str, prediction: str) -> DataFrame:
    return df.groupBy(subject).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def binary_scores(df: DataFrame, keys: list[str], label: str, prediction: str) -> DataFrame:
    """Sensitivity, specificity, balanced accuracy and prevalence."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    out = df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for c, n in ((y & p, "tp"), (y & ~p, "fn"), (~y & p, "fp"), (~y & ~p, "tn"))])
    out = out.withColumn("sensitivity", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("specificity", F.try_divide("tn", F.col("tn") + F.col("fp")))
    return out.select(*keys, "sensitivity", "specificity", ((F.col("sensitivity") + F.col("specificity")) / 2).alias("balanced_accuracy"), ((F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"))).alias("prevalence"))


def rate_at(curve: DataFrame, keys: list[str], fpr: float = 0.2) -> DataFrame:
    """The true positive rate where the false positive rate is nearest to a value."""
    return curve.groupBy(*keys).agg(F.min_by("tpr", F.struct(F.abs(F.col("fpr") - fpr), "fpr", "tpr")).alias("tpr"))


def repaired_softmax(v: Column) -> Column:
    """Non-finite scores repaired and then made probabilities; finite ones as they are."""
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, V.softmax(F.transform(v, V.repaired))).otherwise(v)


def sampling_weights(df: DataFrame, image: str, label: str, weights: DataFrame) -> DataFrame:
    """An image's weight: the mean weight of its labels."""
    return df.select(image, label).distinct().join(weights, label).groupBy(image).agg(F.avg("weight").alias("weight"))


def permuted(cells: DataFrame, order: DataFrame) -> DataFrame:
    """Matrix cells (i, j, n) with rows and columns at new places (old, new)."""
    a = order.select(F.col("old").alias("i"), F.col("new").alias("_i"))
    b = order.select(F.col("old").alias("j"), F.col("new").alias("_j"))
    return cells.join(a, "i").join(b, "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "n")


def neighbour_shares(counts: DataFrame, subject: str, image: str) -> DataFrame:
    """Shares of touching labels: an image's rows in per cent, their mean over a subject's images that have the row, then over subjects likewise."""
    one, of_subject = Window.partitionBy(image, "of"), Window.partitionBy(subject, "of")
    first = lambda *by: (F.row_number().over(Window.partitionBy(*by).orderBy("label")) == 1).cast("long")
    # images and subjects are counted by their first rows, so the table of counts is read once
    share = counts.where(F.col("of").isNotNull()).withColumn("share", 100 * F.col("n") / F.sum("n").over(one)).withColumn("_image", first(subject, image, "of"))
    by_subject = share.groupBy(subject, "of", "label").agg(F.sum("share").alias("_s"), F.sum("_image").alias("_i"))
    by_subject = by_subject.withColumn("share", F.col("_s") / F.sum("_i").over(of_subject)).withColumn("_subject", first(subject, "of"))
    known = F.when(F.col(subject).isNotNull(), F.col("share"))
    out = by_subject.groupBy("of", "label").agg(F.sum(known).alias("_s"), F.sum("_subject").alias("_k"))
    subjects = F.sum("_k").over(Window.partitionBy("of"))  # a row a pair of labels
    return out.withColumn("share", F.col("_s") / subjects).where(F.col("_s").isNotNull()).select("of", "label", "share")


def repeated_transform(df: DataFrame, transform, epochs: int, keys: list[str], spectrum: str) -> DataFrame:
    """Group medians of a transformation done ``epochs`` times (it gets the rows and the epoch column)."""
    rows = df.withColumn("epoch_index", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return V.elementwise(transform(rows, F.col("epoch_index")), ["epoch_index", *keys], spectrum, "median")


def blended(v: Column, matrix: list[list[float]], offset: list[float], amount: Column) -> Column:
    """Linear blend of a spectrum and its projection."""
    return F.zip_with(v, V.affine(v, matrix, offset), lambda x, y: x + amount * (y - x))


def least_important(importances: DataFrame, feature: str, value: str) -> DataFrame:
    """The feature of the lowest mean importance, which an elimination step drops."""
    return importances.groupBy(feature).agg(F.avg(value).alias("_m")).agg(F.min_by(feature, F.struct("_m", feature)).alias(feature))


def eliminated(importances: DataFrame, feature: str, value: str, order: str) -> DataFrame:
    """Features in the order in which repeated elimination by given importances drops them."""
    means = importances.groupBy(feature).agg(F.avg(value).alias("_m"))
    return means.withColumn(order, F.row_number().over(Window.orderBy("_m", feature))).drop("_m")


def principal_components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Rows with their projection on the first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_x", outputCol="_y").fit(rows).transform(rows).withColumn("components", vector_to_array("_y")).drop("_x", "_y")
