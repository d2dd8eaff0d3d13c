"""Selections of a table that make a study's cohorts, and checks that its parts share nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import union_tables
from .checks import _violations


def tagged(df: DataFrame, tags: str, tag: str, required: list[str] = ()) -> DataFrame:
    """Rows whose text of tags holds a tag, literally, and whose required columns are filled."""
    out = df.where(F.coalesce(F.contains(F.col(tags), F.lit(tag)), F.lit(False)))
    return reduce(lambda d, c: d.where(F.col(c).isNotNull()), required, out)


def complete_groups(df: DataFrame, group: str, label: str, labels: list[str]) -> DataFrame:
    """Rows of wanted labels from groups (cameras) that have recordings of every one of them."""
    rows = df.where(F.col(label).isin(labels))
    whole = rows.groupBy(group).agg(F.count_distinct(label).alias("_n")).where(F.col("_n") == len(set(labels))).select(group)
    return rows.join(whole, group, "left_semi")


def by_part(df: DataFrame, part: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that fit the rule of their part (species); parts without a rule and null parts are left out."""
    fits = F.lit(False)
    for name, rule in rules.items():
        fits = fits | ((F.col(part) == name) & F.coalesce(rule, F.lit(False)))
    return df.where(F.coalesce(fits, F.lit(False)))


def dosed(df: DataFrame, seconds: str, limit: float = 600, dosed_state: str = "icg", other: str = "physiological") -> DataFrame:
    """What an array of seconds since each dose tells: ``last_injection`` (the least), ``series`` (how many),
    ``clear`` (within the limit) and ``perfusion_state``.  No array, or an empty one, is no dose."""
    some = F.coalesce(F.size(seconds) > 0, F.lit(False))
    last = F.when(some, F.array_min(seconds))
    return df.withColumns({"last_injection": last, "series": F.when(some, F.size(seconds)), "clear": F.coalesce(last <= limit, F.lit(False)), "perfusion_state": F.when(some, dosed_state).otherwise(other)})


def without_subjects(df: DataFrame, others: DataFrame, subject: str) -> DataFrame:
    """Rows of subjects that another cohort (training data) doesn't have; rows without a subject stay."""
    return df.join(others.select(subject).distinct(), subject, "left_anti")


def paper(parts: dict[str, tuple[DataFrame, Column]], flag: str, flagged: set[str]) -> DataFrame:
    """The chosen rows of several cohorts one below the other, with the cohort's name as ``cohort`` and a flag for some of them."""
    out = union_tables({n: d.where(F.coalesce(c, F.lit(False))) for n, (d, c) in parts.items()}, "cohort")
    return out.withColumn(flag, F.col("cohort").isin(sorted(flagged)))


def shared_between_splits(spec: DataFrame, key: str, fold: str = "fold_name", split: str = "split_name", may: tuple[str, ...] = ()) -> DataFrame:
    """Violations: keys (images, subjects) that are in several splits of a fold.  Splits in ``may`` can share with all."""
    rows = spec.where(~F.col(split).isin(list(may))) if may else spec
    odd = rows.groupBy(fold, key).agg(F.count_distinct(split).alias("_n")).where("_n > 1")
    return _violations(odd, [fold, key], f"{key} in several splits")


def empty_splits(spec: DataFrame, wanted: list[str], fold: str = "fold_name", split: str = "split_name") -> DataFrame:
    """Violations: splits that a fold lacks."""
    every = spec.select(fold).distinct().withColumn(split, F.explode(F.array(*map(F.lit, wanted))))
    return _violations(every.join(spec.select(fold, split).distinct(), [fold, split], "left_anti"), [fold, split], "empty split")
