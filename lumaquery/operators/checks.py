"""Consistency of tables as DataFrames of violations, and fold assignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt
from .bootstrap import uniform


def repeated_keys(df: DataFrame, keys: list[str], name: str = "repeated key") -> DataFrame:
    rows = dealt(df.select(*keys), df.count(), *keys)
    return _violations(rows.groupBy(*keys).count().where("count > 1"), keys, name)


def missing_keys(df: DataFrame, reference: DataFrame, keys: list[str], name: str = "missing key") -> DataFrame:
    """Keys of ``df`` that the reference lacks."""
    n = max(df.count(), reference.count())
    return _violations(dealt(df.select(*keys), n, *keys).distinct().join(dealt(reference.select(*keys), n, *keys), keys, "left_anti"), keys, name)


def shared_keys(parts: dict[str, DataFrame], keys: list[str], name: str = "key in several parts") -> DataFrame:
    """Keys that are in more than one part."""
    rows = reduce(DataFrame.unionByName, [d.select(*keys).withColumn("_part", F.lit(p)) for p, d in parts.items()])
    once = dealt(rows, rows.count(), *keys).distinct()
    return _violations(once.groupBy(*keys).count().where("count > 1"), keys, name)


def unequal_counts(df: DataFrame, keys: list[str], name: str = "unequal counts") -> DataFrame:
    """Groups whose number of rows differs from the most usual number."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    usual = counts.groupBy("_n").agg(F.count("*").alias("_k")).agg(F.max_by("_n", F.struct("_k", "_n")).alias("_n"))
    return _violations(counts.join(usual, "_n", "left_anti"), keys, name)


def _violations(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(F.lit(name).alias("check"), F.concat_ws("#", *[F.col(k).cast("string") for k in keys]).alias("key"))


def enforce(violations: DataFrame) -> DataFrame:
    """Raises when a violation is read."""
    return violations.withColumn("key", F.raise_error(F.concat_ws(": ", "check", "key")).cast("string"))


def split_of(images: DataFrame, spec: DataFrame, keys: list[str]) -> DataFrame:
    """Images with their one split; an error for an image in several."""
    one = spec.groupBy(*keys).agg(F.collect_set("split_name").alias("_s"))
    name = F.when(F.size("_s") == 1, F.col("_s")[0]).otherwise(F.raise_error(F.lit("an image is in several splits")))
    return images.join(one, keys).withColumn("split_name", name).drop("_s")


def update_validation(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old results updated by new ones; repeated keys on either side are an error."""
    from .joins import update

    single = lambda d: d.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("repeated key")).cast("boolean"))).drop("_n")
    return update(single(old), single(new), keys)


def leave_one_out(df: DataFrame, subject: str, image: str) -> DataFrame:
    """(fold_name, split_name, image): each subject's images are one fold's validation set."""
    images = df.select(subject, image).distinct()
    # the result has a row for each image and fold, so the subjects are few
    every = images.agg(F.collect_set(subject)).scalar()
    train = images.withColumn("_out", F.explode(every)).where(F.col(subject) != F.col("_out"))
    name = lambda c: F.concat(F.lit("fold_"), F.col(c).cast("string"))
    return train.select(name("_out").alias("fold_name"), F.lit("train").alias("split_name"), image).unionAll(images.select(name(subject), F.lit("val"), image))


def grouped_folds(df: DataFrame, folds: DataFrame, subject: str, image: str, seed: int = 0) -> DataFrame:
    """Folds of fixed subject groups (fold_name, subject); one image of every training subject is set aside as known."""
    images = df.select(subject, image).distinct()
    names = folds.select("fold_name").distinct()
    every = images.withColumn("fold_name", F.explode(names.agg(F.collect_list("fold_name")).scalar()))  # some few folds
    held = folds.select("fold_name", subject, F.lit(True).alias("_val"))
    placed = every.join(held, ["fold_name", subject], "left")
    w = Window.partitionBy("fold_name", subject).orderBy(uniform(seed, F.col("fold_name"), F.col(image).cast("string")), image)
    known = F.col("_val").isNull() & (F.row_number().over(w) == 1)
    return placed.withColumn("split_name", F.when(F.col("_val"), "val").when(known, "val_known").otherwise("train")).select("fold_name", "split_name", image)


def stratified_folds(df: DataFrame, subject: str, label: str, k: int) -> DataFrame:
    """(subject, fold): subjects of each label combination dealt round to the folds, so folds share no subject and labels are even."""
    kinds = df.groupBy(subject).agg(F.concat_ws(",", F.sort_array(F.collect_set(F.col(label).cast("string")))).alias("_kind"), F.count("*").alias("_n"))
    w = Window.partitionBy("_kind").orderBy(F.desc("_n"), subject)
    return kinds.select(subject, F.pmod(F.row_number().over(w) - 1 + F.floor(uniform(0, F.col("_kind")) * k), F.lit(k)).cast("int").alias("fold"))


def nested_folds(df: DataFrame, subject: str, label: str, outer: int, inner: int) -> DataFrame:
    """(subject, outer_fold, fold, split): stratified folds, and within each one's training subjects folds of their own.

    ``split`` is ``test`` in the outer fold, ``val`` in the inner and ``train`` else.
    """
    dealt = stratified_folds(df, subject, label, outer).withColumnRenamed("fold", "_own")
    rows = dealt.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    kinds = df.groupBy(subject).agg(F.concat_ws(",", F.sort_array(F.collect_set(F.col(label).cast("string")))).alias("_kind"), F.count("*").alias("_n"))
    test = F.col("_own") == F.col("outer_fold")
    w = Window.partitionBy("outer_fold", "_kind", test).orderBy(F.desc("_n"), subject)
    rows = rows.join(kinds, subject).withColumn("_inner", F.pmod(F.row_number().over(w) - 1, F.lit(inner)))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
    return rows.select(subject, "outer_fold", "fold", F.when(test, "test").when(F.col("_inner") == F.col("fold"), "val").otherwise("train").alias("split"))


def subset_series(df: DataFrame, subject: str, sizes: list[int], seeds: int, tries: int = 100) -> DataFrame:
    """(size, seed, subject): for each size as many different random sets of subjects as there are seeds.

    A try takes the subjects with the smallest draws; a set that an earlier try of its size has
    is passed over.  Fewer sets come out where ``tries`` do not give enough different ones.
    """
    subjects = df.select(subject).distinct()
    drawn = subjects.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    w = Window.partitionBy("_try").orderBy(uniform(0, F.col("_try"), F.col(subject)), subject)
    placed = drawn.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(sizes))
    sets = placed.withColumn("size", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda n: n >= F.col("_k"))))
    sets = sets.groupBy("size", "_try").agg(F.sort_array(F.collect_list(subject)).alias("_set")).where(F.size("_set") == F.col("size"))
    first = sets.groupBy("size", "_set").agg(F.min("_try").alias("_try"))
    chosen = first.withColumn("seed", F.row_number().over(Window.partitionBy("size").orderBy("_try")) - 1).where(F.col("seed") < seeds)
    return chosen.select("size", "seed", F.explode("_set").alias(subject))


def large_enough(df: DataFrame, image: str, inside: Column, least: int) -> DataFrame:
    """Images with more than ``least`` rows inside."""
    return df.groupBy(image).agg(F.count_if(inside).alias("_n")).where(F.col("_n") > least).select(image)


def with_all_labels(df: DataFrame, image: str, label: str, labels: list) -> DataFrame:
    """Images that show all of the labels."""
    return df.where(F.col(label).isin(labels)).groupBy(image).agg(F.count_distinct(label).alias("_n")).where(F.col("_n") == len(set(labels))).select(image)
