"""Ordered analytics: relative times, first dates, stable spells, moving means, gaps, percentile rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(at: str) -> Column:
    """Microseconds of a time with or without a zone."""
    return F.unix_micros(F.col(at).cast("timestamp"))


def relative_time(df: DataFrame, keys: list[str], at: str, name: str = "rel_time") -> DataFrame:
    """Seconds since the group's first time."""
    return df.withColumn(name, (micros(at) - F.min(micros(at)).over(Window.partitionBy(*keys))) / 1e6)


def first_dates(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """All rows of each group's first date, ties kept."""
    ranked = df.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.to_date(at))))
    return ranked.where("_r = 1").drop("_r")


def stable(df: DataFrame, key: str, at: str, value: str, days: int, name: str = "stable") -> DataFrame:
    """Whether only one value occurs from the row's day to ``days`` days later."""
    w = Window.partitionBy(key).orderBy(F.unix_date(F.to_date(at))).rangeBetween(0, days)
    return df.withColumn(name, F.size(F.collect_set(value).over(w)) == 1)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 5, name: str = "moving") -> DataFrame:
    """Mean of ``width`` consecutive rows; rows without a full frame are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.avg(value).over(w.rowsBetween(1 - width, 0))).withColumn("_n", F.row_number().over(w))
    return out.where(F.col("_n") >= width).drop("_n")


def interpolated(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Missing values by linear interpolation over ``at``; the ends keep the edge value."""
    upto = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    out = df.withColumn("_b", F.last(known, ignorenulls=True).over(upto(F.asc(at)))).withColumn("_a", F.last(known, ignorenulls=True).over(upto(F.desc(at))))
    b, a, x = F.col("_b"), F.col("_a"), F.col(at).cast("double")
    between = b["y"] + (a["y"] - b["y"]) * (x - b["x"]) / (a["x"] - b["x"])
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(b.isNull(), a["y"]).when(a.isNull(), b["y"]).otherwise(between)
    return out.withColumn(value, filled).drop("_a", "_b")


def percentile_row(df: DataFrame, keys: list[str], order: list[str], q: float) -> DataFrame:
    """The row at place round(q n) of each group's order, halves rounded to even."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return out.where(F.col("_i") == F.least(F.bround(F.lit(q) * F.col("_n")).cast("int"), F.col("_n") - 1)).drop("_i", "_n")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "total") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def best_rows(df: DataFrame, keys: list[str], by: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in an order."""
    out = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return out.where(F.col("_k") <= n).drop("_k")
