"""Names, composite keys, pseudonyms, times and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP = "yyyy_MM_dd_HH_mm_ss"


def join_key(*parts: Column) -> Column:
    return F.concat_ws("#", *parts)


def with_annotations(image: Column, annotations: Column) -> Column:
    """``image@a&b``; without annotations the image alone."""
    return F.when(F.size(annotations) > 0, F.concat(image, F.lit("@"), F.array_join(annotations, "&"))).otherwise(image)


def split_key(key: Column) -> Column:
    """``subject#time@a&b`` as (image, subject, time, annotations)."""
    halves = F.split(key, "@")
    image = halves[0]
    annotations = F.when(F.size(halves) > 1, F.split(F.get(halves, F.lit(1)), "&")).otherwise(F.array().cast("array<string>"))
    fields = F.split(image, "#")
    return F.struct(image.alias("image"), fields[0].alias("subject"), F.get(fields, F.lit(1)).alias("time"), annotations.alias("annotations"))


def timestamp(text: Column) -> Column:
    return F.to_timestamp(text, TIMESTAMP)


def pseudonym(name: Column, salt: str) -> Column:
    return F.sha2(F.concat(name, F.lit(salt)), 256)


def json_at(json: Column, path: str, default: str | None = None) -> Column:
    """Value at ``a/b/c`` of a JSON text."""
    return F.coalesce(F.get_json_object(json, "$." + path.replace("/", ".")), F.lit(default))


def images_per_epoch(text: Column, batch: int) -> Column:
    """Number in a text like "500 images", rounded up to whole batches."""
    return (F.ceil(F.regexp_extract(text, r"(\d+)", 1).cast("int") / batch) * batch).cast("int")


def any_filled(*columns: str) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def holds(column: str, text: str) -> Column:
    """Text is part of the column; false for null."""
    return F.coalesce(F.contains(F.col(column), F.lit(text)), F.lit(False))


def first_filled(columns: list[str], required: bool = False) -> Column:
    """The first of several columns that is not null, else null or an error."""
    values = [F.col(c).cast("string") for c in columns]
    last = [F.raise_error(F.lit(f"none of {columns} is filled")).cast("string")] if required else []
    return F.coalesce(*values, *last)
