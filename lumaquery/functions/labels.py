"""Label mappings as dimension tables, domain indices and orders of labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelMapping:
    """Names to indices; several names may share an index, the first names it.

    Indices up to ``last_valid`` are valid; with ``zero_is_invalid`` index 0 is not.
    ``unknown``: what a name that isn't listed becomes: "invalid" (the next index
    after the valid ones), "null" or "error".
    """

    names: dict[str, int]
    last_valid: int
    zero_is_invalid: bool = False
    unknown: str = "null"

    def frame(self, spark: SparkSession) -> DataFrame:
        """``label_name``, ``label_index``, ``label_valid``: some tens of rows."""
        rows = [(n, i, self.valid(i)) for n, i in self.names.items()]
        return spark.createDataFrame(rows, "label_name string, label_index int, label_valid boolean")

    def valid(self, index: int) -> bool:
        return index <= self.last_valid and (index > 0 or not self.zero_is_invalid)

    def index(self, name: Column) -> Column:
        """Index of a name."""
        pairs = [x for n, i in self.names.items() for x in (F.lit(n), F.lit(i))]
        found = F.try_element_at(F.create_map(*pairs), name)
        if self.unknown == "invalid":
            return F.coalesce(found, F.lit(self.last_valid + 1))
        if self.unknown == "error":
            return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown label: "), name)).cast("int"))
        return found

    def name(self, index: Column) -> Column:
        """First name of an index; "unknown" for an index that has none."""
        first: dict[int, str] = {}
        for n, i in self.names.items():
            first.setdefault(i, n)
        pairs = [x for i, n in first.items() for x in (F.lit(i), F.lit(n))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), index), F.lit("unknown"))

    def is_valid(self, index: Column) -> Column:
        ok = index <= self.last_valid
        return ok & (index > 0) if self.zero_is_invalid else ok

    def renamed(self, old: str, new: str) -> LabelMapping:
        return LabelMapping({new if n == old else n: i for n, i in self.names.items()}, self.last_valid, self.zero_is_invalid, self.unknown)

    def appended(self, name: str) -> LabelMapping:
        """A further valid label; an invalid one in its place moves to the next free index."""
        at, names = self.last_valid + 1, dict(self.names)
        taken = [n for n, i in names.items() if i == at]
        if taken:
            free = next(i for i in range(at + 1, 256) if i not in names.values())
            names |= dict.fromkeys(taken, free)
        return LabelMapping({**names, name: at}, at, self.zero_is_invalid, self.unknown)

    def to(self, other: LabelMapping) -> dict[int, int]:
        """Own indices to the other's, by name."""
        return {i: other.names[n] for n, i in self.names.items() if n in other.names}


def remap(value: Column, pairs: dict[int, int]) -> Column:
    """Values replaced by a table, others as they are."""
    if not pairs:
        return value
    flat = [x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*flat), value), value)


def apply_mapping(df: DataFrame, mapping: LabelMapping, spark: SparkSession | None = None) -> DataFrame:
    """Keep rows with valid mapped labels; ``label_index`` becomes the target index."""
    index = mapping.index(F.col("label_name"))
    return df.withColumn("label_index", index).where(F.col("label_index").isNotNull() & mapping.is_valid(F.col("label_index")))


def domain_index(df: DataFrame, domain: str, name: str = "domain_index") -> DataFrame:
    """Adds a dense index (from 0) over the sorted names of a domain.

    The names are aggregated first, so the ordering sees one row a name.
    """
    names = df.select(domain).where(F.col(domain).isNotNull()).distinct()
    ranked = names.withColumn(name, (F.dense_rank().over(Window.orderBy(domain)) - 1).cast("int"))
    return df.join(ranked, domain, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def order_key(column: str, order: dict[str, int] | list[str]) -> list[Column]:
    """Sorting columns: known names in their order, unknown ones after them by name."""
    order = dict(zip(order, range(len(order)), strict=True)) if isinstance(order, list) else order
    flat = [x for k, v in order.items() for x in (F.lit(k), F.lit(v))]
    place = F.try_element_at(F.create_map(*flat), F.col(column)) if flat else F.lit(None).cast("int")
    return [place.isNull(), place, F.col(column)]


def sort_labels(df: DataFrame, order: dict[str, int] | list[str], by: tuple[str, ...] = ("label_name", "image_name", "annotation_name")) -> DataFrame:
    """Rows in label order, then by image and annotation where the table has them."""
    keys = [c for n in by if n in df.columns for c in (order_key(n, order) if n == "label_name" else [F.col(n)])]
    return df.orderBy(*keys)


def by_given_order(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows in the order of a list of values; first mentions count."""
    wanted = list(dict.fromkeys(values))
    rows = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(wanted)], f"`{column}` string, _order int")
    return df.join(rows, column).orderBy("_order").drop("_order")
