"""Median-spectra tables: a partitioned catalogue, and the readers that filter, map and unite it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import elementwise
from ..functions.labels import LabelMapping, apply_mapping, sort_labels
from ..operators.aggregates import one_value


def write_median_table(df: DataFrame, root: str, mode: str = "append") -> None:
    """One folder a dataset, table and annotation; the three columns live in the paths.

    Rows are dealt by folder, and a folder with many rows is split over tasks and files.
    """
    parts = ["dataset_name", "table_name", "annotation_name"]
    df.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts).option("mergeSchema", "true").parquet(root)


def read_median_tables(spark: SparkSession, root: str) -> DataFrame:
    """All tables; filters on dataset, table and annotation prune folders."""
    return spark.read.option("mergeSchema", "true").parquet(root)


def missing_images(wanted: DataFrame, existing: DataFrame, key: str = "image_name") -> DataFrame:
    """Images that are still to be computed."""
    return wanted.join(existing.select(key).distinct(), key, "left_anti")


def named(tables: DataFrame, dataset: str, table: str = "") -> DataFrame:
    """A dataset's table; if there is none of that very name, those of its sub-datasets."""
    t = tables.where(F.coalesce("table_name", F.lit("")) == table)
    exact = t.where(F.col("dataset_name") == dataset)
    rest = t.where(F.startswith(F.col("dataset_name"), F.lit(f"{dataset}#")))
    there = exact.select(F.count("*").alias("n")).scalar()
    return exact.unionByName(rest.where(there == 0))


def median_table(tables: DataFrame, dataset_name: str | None = None, table_name: str = "", image_names: list[str] | None = None, annotation_name: str | list[str] | None = None, label_mapping: LabelMapping | None = None, keep_mapped_columns: bool = True, additional_mappings: dict[str, dict] | None = None, image_labels: list[str] | None = None, order: dict[str, int] | None = None, priority: list[str] | None = None) -> DataFrame:
    """Rows of one dataset or of given images, mapped, united and sorted by label.

    Image names may carry annotations (``name@a&b``).  Of images found in several
    datasets the first in ``priority`` wins; where datasets mix, ``label_index``
    is only kept if a mapping makes it comparable.
    """
    if (dataset_name is None) == (image_names is None):
        raise ValueError("either a dataset or image names")
    df = named(tables, dataset_name, table_name) if dataset_name else tables.where(F.coalesce("table_name", F.lit("")) == table_name)
    if annotation_name is not None:
        df = df.where(F.col("annotation_name").isin([annotation_name] if isinstance(annotation_name, str) else annotation_name))
    if image_names is not None:
        df = _images(df, image_names, priority)
        if label_mapping is None and "label_index" in df.columns:
            df = _comparable(df)
    if label_mapping is not None:
        old = df.columns
        df = apply_mapping(df.withColumn("_original", F.col("label_index")) if "label_index" in old else df, label_mapping)
        df = df.drop("_original") if not keep_mapped_columns or "_original" not in df.columns else df.withColumnRenamed("_original", "label_index_original")
    for column, pairs in (additional_mappings or {}).items():
        rows = df.sparkSession.createDataFrame(list(pairs.items()), f"`{column}` string, `{column}_index` int")
        df = df.join(rows, column, "left")
    if image_labels:
        from ..functions.keys import first_filled

        df = df.withColumn("image_labels", first_filled([c for c in image_labels if c in df.columns], required=True))
    return sort_labels(df, order or {})


def _images(df: DataFrame, image_names: list[str], priority: list[str] | None) -> DataFrame:
    spark = df.sparkSession
    rows = []
    for n in dict.fromkeys(image_names):
        image, _, annotations = n.partition("@")
        rows += [(image, a) for a in annotations.split("&")] if annotations else [(image, None)]
    wanted = spark.createDataFrame(rows, "image_name string, _a string")
    plain = df.join(wanted.where("_a is null").select("image_name").distinct(), "image_name", "left_semi")
    order = priority or []
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("dataset_name")), F.lit(0)) if order else F.lit(0)
    first = Window.partitionBy("image_name").orderBy(F.when(place == 0, len(order) + 1).otherwise(place), "dataset_name")
    plain = plain.withColumn("_r", F.dense_rank().over(first)).where("_r = 1").drop("_r")
    marked = wanted.where("_a is not null").select("image_name", F.col("_a").alias("annotation_name")).distinct()
    return plain.unionByName(df.join(marked, ["image_name", "annotation_name"], "left_semi")).distinct()


def _comparable(df: DataFrame) -> DataFrame:
    """``label_index`` becomes null where several datasets mix."""
    mixed = df.select(F.count_distinct("dataset_name").alias("n")).scalar()
    return df.withColumn("label_index", F.when(mixed == 1, F.col("label_index")))


def basic_statistics(median: DataFrame, spec: DataFrame | None, mapping: LabelMapping) -> DataFrame:
    """Images and labels with split, mapped index and summed pixels; null splits and annotations are kept."""
    index = mapping.index(F.col("label_name"))
    df = median.withColumn("label_index", index).withColumn("label_valid", F.coalesce(mapping.is_valid(index), F.lit(False)))
    df = df.join(spec.select("image_name", F.col("split_name").alias("set_type")).distinct(), "image_name", "left") if spec is not None else df.withColumn("set_type", F.lit(None).cast("string"))
    keys = [c for c in ("subject_name", "timestamp", "annotation_name", "image_name", "label_index", "label_name", "label_valid", "set_type") if c in df.columns]
    return df.groupBy(*keys).agg(F.sum("n_pixels").alias("n_pixels"))


def group_median_spectra(df: DataFrame, keys: list[str], vectors: list[str], deviations: list[str] = (), constants: list[str] = ()) -> DataFrame:
    """One spectrum a group: element-wise means, means of deviations without NaN, and columns that have one value a group."""
    out = df.groupBy(*keys).agg(*[one_value(c).alias(c) for c in constants], F.count("*").alias("n_spectra"))
    for c in vectors:
        out = out.join(elementwise(df, keys, c), keys)
    for c in deviations:
        out = out.join(elementwise(df, keys, c, skip_nan=True), keys, "left")
    return out


def median_spectra(pixels: DataFrame, keys: list[str], spectrum: str, parameters: list[str] = (), used: str | None = None) -> DataFrame:
    """Median and deviation of spectra and parameters a group.

    ``n_pixels`` counts all the group's pixels, the rest those where ``used`` is
    true.  Spectra have a sample deviation (0 for one pixel), parameters that of the population.
    """
    chosen = pixels.where(used) if used else pixels
    out = pixels.groupBy(*keys).agg(F.count("*").alias("n_pixels"))
    out = out.join(elementwise(chosen, keys, spectrum, "median").withColumnRenamed(spectrum, f"median_{spectrum}"), keys)
    out = out.join(elementwise(chosen, keys, spectrum, "std").withColumnRenamed(spectrum, f"std_{spectrum}"), keys)
    if parameters:
        out = out.join(chosen.groupBy(*keys).agg(*[F.median(p).alias(f"median_{p}") for p in parameters], *[F.stddev_pop(p).alias(f"std_{p}") for p in parameters]), keys)
    return out


def union_tables(parts: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """Tables one below the other by column name, with the part's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn(name, F.lit(n)) for n, d in parts.items()])


def _spec_json(spark: SparkSession, path: str) -> DataFrame:
    """A file of one array or object, or one object a line (as ``write_spec`` writes)."""
    lines = spark.read.text(path)
    single = lines.where(F.trim("value").startswith("{") & F.trim("value").endswith("}")).count() == lines.where(F.trim("value") != "").count()
    return spark.read.option("multiLine", not single).json(path)


def spec_table(spark: SparkSession, path: str, with_test: bool = False) -> DataFrame:
    """(fold_name, split_name, image_name) of a specification; test splits only if asked for.

    A fold is an object of its name and, for each split, an object with ``image_names``.
    """
    raw = _spec_json(spark, path)
    splits = [c for c in raw.columns if c != "fold_name" and (with_test or not c.startswith("test"))]
    one = [F.struct(F.lit(c).alias("split_name"), F.col(f"`{c}`.image_names").alias("images")) for c in splits]
    long = raw.select("fold_name", F.inline(F.array(*one))).select("fold_name", "split_name", F.explode("images").alias("image_name"))
    return long.distinct()


def spec_paths(spec: DataFrame, pattern: str) -> DataFrame:
    """Sorted distinct images of the splits that a pattern is found in."""
    return spec.where(F.col("split_name").rlike(pattern)).select("image_name").distinct().orderBy("image_name")


def write_spec(spec: DataFrame, path: str) -> DataFrame:
    """A specification as JSON that ``spec_table`` reads; what is read back, which must be what was given.

    The file has one fold an element; its splits are few, so their names become its fields.
    """
    splits = [r[0] for r in spec.select("split_name").distinct().orderBy("split_name").collect()]
    lists = [F.struct(F.sort_array(F.collect_set(F.when(F.col("split_name") == c, F.col("image_name")))).alias("image_names")).alias(c) for c in splits]
    folds = spec.groupBy("fold_name").agg(*lists)
    folds.select(F.to_json(F.struct("*")).alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)
    back = spec.sparkSession.read.json(path)
    one = [F.struct(F.lit(c).alias("split_name"), F.col(f"`{c}`.image_names").alias("images")) for c in splits]
    found = back.select("fold_name", F.inline(F.array(*one))).select("fold_name", "split_name", F.explode("images").alias("image_name")) if splits else spec
    given = spec.select("fold_name", "split_name", "image_name").distinct()
    odd = found.exceptAll(given).unionAll(given.exceptAll(found)).limit(1).collect()
    if odd:
        raise ValueError(f"the specification was not written as given: {odd[0]}")
    return found


def fold_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result tables of several folders, with each one's folder name as ``fold_name``."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.withColumn("fold_name", F.element_at(F.split(F.input_file_name(), "/"), -2))
