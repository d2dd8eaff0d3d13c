"""A session with the settings the engine is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lumaquery", **config: str) -> SparkSession:
    """The running session, or a new one: adaptive plans, UTC, Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | config
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def tables(spark: SparkSession, directory: str, *names: str) -> dict:
    """Parquet tables of a folder by name."""
    return {n: spark.read.parquet(f"{directory}/{n}.parquet") for n in names}


#: Rows of a table that one task joins and groups.
TASK_ROWS = 500_000


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The table by keys, in as many parts as n rows (of the larger table that it meets) need: a task's memory doesn't grow with the input."""
    return df.repartition(max(1, -(-n // TASK_ROWS)), *keys)
