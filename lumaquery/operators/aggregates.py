"""Hierarchical means, matrix sums, functional dependencies and group choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain(c: Column) -> Column:
    """NaN as null, so that means leave it out."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def explode_parallel(df: DataFrame, arrays: list[str], keep: list[str]) -> DataFrame:
    """One row an element of arrays of equal lengths; an empty list keeps its row with nulls."""
    sizes = [F.size(c) for c in arrays]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    checked = F.when(same, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays of different lengths")))
    return df.select(*keep, F.inline_outer(checked))


def best_epoch(df: DataFrame, dataset_index: int | None = 0, best_only: bool = True) -> DataFrame:
    """Rows of the best epoch and of one dataset, where the table has such columns."""
    if best_only and {"epoch_index", "best_epoch_index"} <= set(df.columns):
        df = df.where("epoch_index = best_epoch_index")
    if dataset_index is not None and "dataset_index" in df.columns:
        df = df.where(F.col("dataset_index") == dataset_index)
    return df


def means(df: DataFrame, metrics: list[str], *levels: list[str]) -> DataFrame:
    """Mean of means: the rows' mean for the first keys, the mean of these for the next, and so on.

    Levels stay apart, for the mean of all rows is another number.  Null keys are left out.
    """
    for keys in levels:
        for k in keys:
            df = df.where(F.col(k).isNotNull())
        df = df.groupBy(*keys).agg(*[F.avg(plain(F.col(m))).alias(m) for m in metrics])
    return df


def grouped_metrics(df: DataFrame, metrics: list[str], domains: list[str] = (), subject: str = "subject_name", image: str = "image_name", label: str = "used_labels", mode: str = "class_level", keep_subjects: bool = False, no_aggregation: bool = False, dataset_index: int | None = 0, best_epoch_only: bool = True, per_epoch: bool = False) -> DataFrame:
    """Metrics of parallel arrays (one value a used label) over a hierarchy.

    class_level: image, label -> subject, label -> domain, label.
    image_level: mean over an image's labels -> subject -> domain.
    """
    df = best_epoch(df, dataset_index, best_epoch_only)
    extra = [*domains, *([c for c in ("fold_name", "epoch_index") if c in df.columns] if per_epoch else [])]
    rows = explode_parallel(df, [label, *metrics], [*extra, subject, image])
    if no_aggregation:
        return rows
    if mode == "class_level":
        levels = [[*extra, subject, label]] if keep_subjects else [[*extra, subject, label], [*extra, label]]
    else:
        levels = [[*extra, subject, image], [*extra, subject]]
        if not keep_subjects and extra:
            levels.append(extra)
    return means(rows, list(metrics), *levels)


def checkpoint_score(df: DataFrame, metric: str, domain: str, subject: str = "subject_name", image: str = "image_name", label: str = "used_labels", mode: str = "class_level") -> DataFrame:
    """One score for a table: label means over domains, or subject means, averaged."""
    rows = explode_parallel(best_epoch(df), [label, metric], [domain, subject, image])
    if mode == "class_level":
        levels = [[domain, subject, label], [domain, label], [label]]
    else:
        levels = [[domain, subject, image], [domain, subject], [subject]]
    return means(rows, [metric], *levels).agg(F.avg(metric).alias(metric))


def matrix_sum(df: DataFrame, keys: list[str], matrix: str) -> DataFrame:
    """Sum of matrices a group, cell by cell."""
    rows = df.select(*keys, F.posexplode(matrix).alias("_i", "_row"))
    cells = rows.select(*keys, "_i", F.posexplode("_row").alias("_j", "_x"))
    sums = cells.groupBy(*keys, "_i", "_j").agg(F.sum("_x").alias("_x"))
    lines = sums.groupBy(*keys, "_i").agg(F.transform(F.sort_array(F.collect_list(F.struct("_j", "_x"))), lambda s: s["_x"]).alias("_row"))
    return lines.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_row"))), lambda s: s["_row"]).alias(matrix))


def one_value(column: str) -> Column:
    """The group's only value; an error if it has several."""
    return F.when(F.count_distinct(column) <= 1, F.any_value(column, True)).otherwise(F.raise_error(F.lit(f"{column} is not unique in a group")))


def domain_accuracy(df: DataFrame, truth: str, prediction: str, subject: str = "subject_name", image: str = "image_name") -> DataFrame:
    """Share of a subject's images whose domain was predicted, each image once."""
    images = df.groupBy(subject, image).agg(one_value(truth).alias("_t"), one_value(prediction).alias("_p"))
    return images.groupBy(subject).agg(F.avg((F.col("_t") == F.col("_p")).cast("double")).alias("accuracy"))


def implode(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows of a group as parallel arrays in the order of a column."""
    packed = F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    out = df.groupBy(*keys).agg(packed.alias("_s"))
    field = lambda c: F.transform("_s", lambda s: s[c])
    return out.select(*keys, *[field(c).alias(c) for c in columns])


def most_common(df: DataFrame, keys: list[str], label: str, total: str = "n") -> DataFrame:
    """The most frequent label of a group, the smallest of equally frequent ones."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("_n", -F.col(label))).alias(label), F.sum("_n").alias(total))


def presence(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Which values each row key has, as 0 and 1."""
    return df.groupBy(row).pivot(column, values).agg(F.lit(1)).na.fill(0)


def class_weights(counts: DataFrame, label: str = "label_index", n: str = "n", scaling: float = -2.0) -> DataFrame:
    """Weights by five rules from label counts (one row a label).

    ``one``: 1; ``share``: (total - n) / total, scaled to add up to 1; ``inverse``: 1 / n
    likewise; ``softmin``: softmax of the shares times ``scaling``; ``nll``: -ln of shares.
    """
    sums = counts.agg(F.sum(n).alias("_total"), F.sum(1 / F.col(n)).alias("_inverse"), F.count("*").alias("_labels"))
    out = counts.join(F.broadcast(sums)).withColumn("_share", F.col(n) / F.col("_total"))  # one row of sums
    soft = out.agg(F.sum(F.exp(scaling * F.col("_share")))).scalar()
    share = F.when(F.col("_labels") > 1, (1 - F.col("_share")) / (F.col("_labels") - 1))
    return out.select(*counts.columns, F.lit(1.0).alias("one"), share.alias("share"), (1 / F.col(n) / F.col("_inverse")).alias("inverse"), (F.exp(scaling * F.col("_share")) / soft).alias("softmin"), (-F.ln("_share")).alias("nll"))


def relative_change(df: DataFrame, keys: list[str], value: str, is_base: Column) -> DataFrame:
    """(x - m) / m against the mean of the group's base rows."""
    base = df.where(is_base).groupBy(*keys).agg(F.avg(value).alias("_m"))
    return df.join(base, keys).withColumn("change", (F.col(value) - F.col("_m")) / F.col("_m")).drop("_m")


def reduced_tolerance(distances: DataFrame, subject: str, value: str, how: str = "mean") -> DataFrame:
    """Mean and deviation over subjects of each subject's reduced distances."""
    one = {"mean": F.avg(value), "median": F.median(value), "q75": F.percentile(value, 0.75), "q95": F.percentile(value, 0.95)}[how]
    each = distances.groupBy(subject).agg(one.alias("_v"))
    return each.agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
