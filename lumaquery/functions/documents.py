"""Nested documents (JSON, VARIANT): deep merge, and metadata of differing keys as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that a merge goes down; documents that meet deeper are an error.
DEPTH = 12
_MAP = "map<string,variant>"


def _object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def deep_merged(first: Column, second: Column, depth: int = DEPTH) -> Column:
    """Two VARIANT documents merged on every level where both hold objects; else the second wins, null values too.

    A document that is missing (SQL NULL) leaves the other one.  Keys come out sorted.  Objects
    that meet below ``depth`` levels are an error.
    """
    either = F.coalesce(second, first)
    if not depth:
        return F.when(_object(first) & _object(second), F.raise_error(F.lit("documents meet below the deepest level")).cast("variant")).otherwise(either)
    inner = F.map_zip_with(first.cast(_MAP), second.cast(_MAP), lambda _, x, y: deep_merged(x, y, depth - 1))
    return F.when(_object(first) & _object(second), F.to_variant_object(inner)).otherwise(either)


def merged_text(first: Column, second: Column, depth: int = DEPTH) -> Column:
    """The same for JSON texts, as JSON text with sorted keys; a text that is no JSON is an error."""
    return F.to_json(deep_merged(F.parse_json(first), F.parse_json(second), depth))


def leaves(docs: DataFrame, key: str, document: str, depth: int = DEPTH) -> DataFrame:
    """(key, path, value): the values of VARIANT documents that are no objects, with dotted paths.  Objects below
    ``depth`` levels stay values."""
    out, rest = None, docs.select(key, F.lit("").alias("path"), F.col(document).alias("value")).where("value is not null")
    for level in range(depth + 1):
        here = rest if level == depth else rest.where(~_object(F.col("value")))
        out = here if out is None else out.unionAll(here)
        if level < depth:
            # a row an object; Spark stops where no object is left, as there are no rows
            inner = rest.where(_object(F.col("value"))).select(key, "path", F.explode(F.col("value").cast(_MAP)).alias("k", "value"))
            rest = inner.select(key, F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), "k").alias("path"), "value")
    return out


def metadata_table(entries: DataFrame, image: str, key: str = "key", value: str = "value") -> DataFrame:
    """One row an image and a column for each key that any image has (sorted); null where an image lacks it.

    ``entries``: (image, key, value as text); of a key that an image has several times the last in order
    counts.  The keys come to the driver, as they are the table's columns.
    """
    keys = [r[0] for r in entries.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key).collect()]
    return entries.groupBy(image).pivot(key, keys).agg(F.max(value)) if keys else entries.select(image).distinct()


def camera_names(table: DataFrame, changes: DataFrame, at: str, camera: str = "Camera_CamID", explicit: str = "camera_name", default: str = "correct-1") -> DataFrame:
    """``table`` with ``camera_name``: the explicit one where there is one, else the camera and its version.

    ``changes``: (camera, change_date, suffix_before, suffix_after); a camera without a change has the
    ``default`` suffix, an image without a camera the camera ``unknown``.
    """
    cam = F.coalesce(F.col(camera), F.lit("unknown")) if camera in table.columns else F.lit("unknown")
    given = F.col(explicit) if explicit in table.columns else F.lit(None).cast("string")
    rows = table.withColumn("_cam", cam).withColumn("_given", given).drop("camera_name", explicit)
    c = changes.select(F.col("camera").alias("_cam"), F.col("change_date").alias("_date"), "suffix_before", "suffix_after")
    suffix = F.when(F.col("_date").isNull(), default).when(F.col(at) < F.col("_date"), F.col("suffix_before")).otherwise(F.col("suffix_after"))
    out = rows.join(c, "_cam", "left").withColumn("camera_name", F.coalesce("_given", F.concat_ws("_", "_cam", suffix)))
    return out.withColumn(camera, F.col("_cam")).drop("_cam", "_given", "_date", "suffix_before", "suffix_after")
