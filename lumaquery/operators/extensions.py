"""What users add: aggregates of a step and a finish for SQL, and named transformations of images with validity."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf

from ..dialect import known_aggregate
from .bootstrap import uniform


def options(texts: list[str]) -> dict[str, Any]:
    """``'name=value'`` texts as keyword arguments; values that are numbers become floats."""
    out: dict[str, Any] = {}
    for text in texts:
        name, _, value = text.partition("=")
        if not _ or not name.strip():
            raise ValueError(f"an option is 'name=value', not {text!r}")
        value = value.strip()
        out[name.strip()] = float(value) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value) else value
    return out


class Collected:
    """The plainest aggregate: collects values and hands them to a function at the end."""

    def __init__(self, function: Callable):
        self.function, self.values = function, []

    def step(self, value) -> None:
        self.values.append(value)

    def finalize(self, **kwargs):
        return self.function(self.values, **kwargs)


def register_aggregate(spark: SparkSession, name: str, make: Callable[[], Any], returns: str) -> None:
    """Makes an aggregate known to ``sql`` by name: ``SELECT name(x, 'q=0.9') FROM df GROUP BY g``.

    ``make`` gives an object with ``step(value)`` for each value that is not null and ``finalize(**options)``
    at the end.  A group's values are one task's, as for every Python aggregate of Spark; an
    aggregate that can be had from Spark's own functions should be.
    """

    def work(values: pd.Series, *texts: pd.Series):
        state = make()
        for v in values:
            if v is not None and v == v:
                state.step(v)
        out = state.finalize(**options([t.iloc[0] for t in texts]))
        return out.item() if hasattr(out, "item") else out

    known_aggregate(name)
    spark.udf.register(name, pandas_udf(work, returns, PandasUDFType.GROUPED_AGG))


@dataclass
class Transformation:
    """A change of an image's cells that may turn out invalid.

    ``draws`` names the numbers in [0, 1) that an attempt has, ``apply`` changes cells that hold them as
    columns, and ``valid`` is an aggregate over an image's changed cells.
    """

    name: str
    apply: Callable[[DataFrame], DataFrame]
    draws: tuple[str, ...] = ()
    valid: Column = field(default_factory=lambda: F.lit(True))


class Registry:
    """Transformations by name."""

    def __init__(self):
        self.known: dict[str, Transformation] = {}

    def add(self, t: Transformation) -> None:
        if t.name in self.known:
            raise ValueError(f"there is a transformation {t.name} already")
        self.known[t.name] = t

    def get(self, name: str) -> Transformation:
        if name not in self.known:
            raise KeyError(f"no transformation {name}; known: {', '.join(sorted(self.known))}")
        return self.known[name]

    def apply(self, cells: DataFrame, image: str, names: list[str], attempts: int = 20, seed: int = 0) -> DataFrame:
        """The named transformations one after the other, each in its first valid attempt of every image."""
        for k, name in enumerate(names):
            cells = first_valid(cells, image, self.get(name), attempts, f"{seed}/{k}/{name}")
        return cells


def first_valid(cells: DataFrame, image: str, t: Transformation, attempts: int, salt: str) -> DataFrame:
    """Cells changed by the first of an image's attempts that is valid; an image without one is an error.

    Attempts differ in their draws, which are hashes of image, attempt and name, so a task that
    runs again tries the same.  All attempts are judged at once and only the chosen one is applied.
    Columns of draws are dropped.
    """
    if not t.draws:
        attempts = 1  # all would be the same
    numbers = [uniform(0, F.lit(salt), F.col(image), F.col("_attempt"), F.lit(d)).alias(d) for d in t.draws]
    tries = cells.select(image).distinct().withColumn("_attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).select(image, "_attempt", *numbers)
    judged = t.apply(cells.join(tries, image)).groupBy(image, "_attempt").agg(t.valid.alias("_valid"))
    first = judged.groupBy(image).agg(F.min(F.when(F.col("_valid"), F.col("_attempt"))).alias("_first"))
    failed = F.raise_error(F.concat(F.lit(f"{t.name}: no valid attempt for image "), F.col(image).cast("string"))).cast("int")
    # a cell of an image whose attempts left no row fails too
    chosen = cells.select(image).distinct().join(first, image, "left").select(image, F.coalesce("_first", failed).alias("_attempt"))
    return t.apply(cells.join(tries.join(chosen, [image, "_attempt"]), image)).drop("_attempt", *t.draws)
