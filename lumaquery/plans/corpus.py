"""SQL statements in the embedded dialect over an annotation table.

Orders stand for images, customers for subjects, part types for labels and
quantities for pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect import sql
from ..session import dealt, tables

STATS = """
WITH df AS (
    SELECT o_orderkey AS image_name, o_custkey AS subject_name, strftime(min(o_orderdate), '%Y_%m_%d_%H_%M_%S') AS timestamp,
           p_type AS label_name, o_orderstatus = 'F' AS is_test, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS set_type,
           CAST(sum(l_quantity) AS BIGINT) AS n_pixels, avg(l_discount) AS dice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    GROUP BY o_orderkey, o_custkey, p_type, o_orderstatus
)
"""


def orders_of(lines: DataFrame, orders: DataFrame, n: int) -> DataFrame:
    """Line items with their orders, dealt by order: what groups by order and more needs no other exchange."""
    return dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an (image, label)."""
    t = tables(spark, sf_dir, "lineitem", "orders", "part")
    rows = orders_of(t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")), t["orders"], t["lineitem"].count())
    keys = [F.col("o_orderkey").alias("image_name"), F.col("o_custkey").alias("subject_name"), F.col("p_type").alias("label_name"), F.col("o_orderstatus").alias("_s")]
    out = rows.groupBy(*keys).agg(F.date_format(F.min("o_orderdate"), "yyyy_MM_dd_HH_mm_ss").alias("timestamp"), F.sum("l_quantity").cast("long").alias("n_pixels"), F.avg("l_discount").alias("dice"))
    return out.select("image_name", "subject_name", "timestamp", "label_name", (F.col("_s") == "F").alias("is_test"), F.when(F.col("_s") != "P", F.col("_s")).alias("set_type"), "n_pixels", "dice")


#: Name: statement in the embedded dialect, and the oracle's where it is spelled otherwise.
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "split_counts_case": (
        """SELECT COUNT(DISTINCT CASE WHEN is_test = 1 THEN subject_name END) AS subjects_test, COUNT(DISTINCT CASE WHEN is_test = 0 THEN subject_name END) AS subjects_train,
           COUNT(DISTINCT CASE WHEN is_test = 1 THEN image_name END) AS images_test, COUNT(DISTINCT image_name) AS images FROM df""",
        """SELECT COUNT(DISTINCT CASE WHEN is_test THEN subject_name END) AS subjects_test, COUNT(DISTINCT CASE WHEN NOT is_test THEN subject_name END) AS subjects_train,
           COUNT(DISTINCT CASE WHEN is_test THEN image_name END) AS images_test, COUNT(DISTINCT image_name) AS images FROM df""",
    ),
    "label_subject_split": (
        """SELECT label_name, COUNT(DISTINCT subject_name) AS n_total, COUNT(DISTINCT CASE WHEN is_test = 1 THEN subject_name END) AS n_test FROM df GROUP BY label_name""",
        """SELECT label_name, COUNT(DISTINCT subject_name) AS n_total, COUNT(DISTINCT CASE WHEN is_test THEN subject_name END) AS n_test FROM df GROUP BY label_name""",
    ),
    "label_annotation_split": (
        """SELECT label_name, COUNT(CASE WHEN is_test = 1 THEN 1 END) AS n_test, COUNT(CASE WHEN is_test = 0 THEN 1 END) AS n_train FROM df GROUP BY label_name""",
        """SELECT label_name, COUNT(CASE WHEN is_test THEN 1 END) AS n_test, COUNT(CASE WHEN NOT is_test THEN 1 END) AS n_train FROM df GROUP BY label_name""",
    ),
    "n_labels_join": (
        """SELECT df.image_name, ROUND(AVG(df.dice), 6) AS mean_dice FROM (SELECT image_name, COUNT(DISTINCT label_name) AS n_labels FROM df GROUP BY image_name) AS c
           INNER JOIN df ON c.image_name == df.image_name WHERE c.n_labels == 4 GROUP BY df.image_name ORDER BY mean_dice DESC""",
        None,
    ),
    "image_mean": ("SELECT image_name, ROUND(AVG(dice), 6) AS mean_dice FROM df WHERE label_name != 'ECONOMY' GROUP BY image_name ORDER BY mean_dice", None),
    "seed_mean_std": (
        "SELECT label_name, ROUND(AVG(dice), 6) AS mean, ROUND(STD(dice), 6) AS std FROM df GROUP BY label_name",
        "SELECT label_name, ROUND(AVG(dice), 6) AS mean, ROUND(stddev_pop(dice), 6) AS std FROM df GROUP BY label_name",
    ),
    "median_quantiles": (
        "SELECT label_name, ROUND(MEDIAN(dice), 6) AS med, ROUND(QUANTILE(dice, 'q=0.25'), 6) AS q25, ROUND(QUANTILE(dice, 'q=0.975'), 6) AS q975 FROM df GROUP BY label_name",
        "SELECT label_name, ROUND(MEDIAN(dice), 6) AS med, ROUND(quantile_cont(dice, 0.25), 6) AS q25, ROUND(quantile_cont(dice, 0.975), 6) AS q975 FROM df GROUP BY label_name",
    ),
    "first_date": ("SELECT subject_name, MIN(timestamp) AS first_timestamp FROM df GROUP BY subject_name", None),
    "label_counts": ("SELECT label_name, subject_name, COUNT(DISTINCT image_name) AS `n images`, CAST(SUM(n_pixels) AS BIGINT) AS n_pixels FROM df GROUP BY label_name, subject_name", "SELECT label_name, subject_name, COUNT(DISTINCT image_name) AS \"n images\", CAST(SUM(n_pixels) AS BIGINT) AS n_pixels FROM df GROUP BY label_name, subject_name"),
    "label_totals": ("SELECT label_name, COUNT(DISTINCT subject_name) AS n_subjects, COUNT(DISTINCT image_name) AS n_images, CAST(SUM(n_pixels) AS BIGINT) AS n_pixels FROM df GROUP BY label_name", None),
    "set_totals": ("SELECT set_type, COUNT(DISTINCT subject_name) AS n_subjects, COUNT(DISTINCT image_name) AS n_images FROM df GROUP BY set_type", None),
    "pixel_ratio": (
        """SELECT image_name, ROUND(CAST(SUM(CASE WHEN label_name = 'PROMO' THEN n_pixels ELSE 0 END) AS FLOAT) / SUM(n_pixels), 6) AS ratio FROM df GROUP BY image_name""",
        """SELECT image_name, ROUND(CAST(SUM(CASE WHEN label_name = 'PROMO' THEN n_pixels ELSE 0 END) AS DOUBLE) / SUM(n_pixels), 6) AS ratio FROM df GROUP BY image_name""",
    ),
    "whole_division": ("SELECT image_name, label_name, n_pixels / 7 AS sevenths FROM df", "SELECT image_name, label_name, n_pixels // 7 AS sevenths FROM df"),
    "train_subjects": ("SELECT label_name, COUNT(DISTINCT subject_name) AS n_subjects FROM df WHERE is_test = 0 GROUP BY label_name ORDER BY n_subjects DESC", "SELECT label_name, COUNT(DISTINCT subject_name) AS n_subjects FROM df WHERE NOT is_test GROUP BY label_name"),
    "label_list": (
        "SELECT set_type, GROUP_CONCAT(DISTINCT label_name) AS labels FROM df WHERE set_type IS NOT NULL GROUP BY set_type",
        "SELECT set_type, string_agg(DISTINCT label_name, ',' ORDER BY label_name) AS labels FROM df WHERE set_type IS NOT NULL GROUP BY set_type",
    ),
    "group_concat_sorted": (
        "SELECT label_name, GROUP_CONCAT(subject_name, '; ') AS subjects FROM (SELECT DISTINCT label_name, subject_name FROM df WHERE n_pixels > 150) AS d GROUP BY label_name",
        "SELECT label_name, string_agg(CAST(subject_name AS VARCHAR), '; ' ORDER BY CAST(subject_name AS VARCHAR)) AS subjects FROM (SELECT DISTINCT label_name, subject_name FROM df WHERE n_pixels > 150) AS d GROUP BY label_name",
    ),
    "single_label_having": (
        "SELECT image_name, COUNT(DISTINCT label_name) AS n_labels FROM df GROUP BY image_name HAVING n_labels = 1 AND label_name = 'PROMO' -- only one label\n",
        "SELECT image_name, COUNT(DISTINCT label_name) AS n_labels FROM df GROUP BY image_name HAVING COUNT(DISTINCT label_name) = 1 AND any_value(label_name) = 'PROMO'",
    ),
    "label_histogram_union": (
        """SELECT n_labels, COUNT(*) AS n_images FROM (SELECT image_name, COUNT(DISTINCT label_name) AS n_labels FROM df GROUP BY image_name) AS c GROUP BY n_labels
           UNION SELECT 0 AS n_labels, COUNT(*) AS n_images FROM (SELECT image_name, COUNT(*) AS n FROM df GROUP BY image_name HAVING n = 1 AND label_name = 'SMALL') AS u""",
        """SELECT n_labels, COUNT(*) AS n_images FROM (SELECT image_name, COUNT(DISTINCT label_name) AS n_labels FROM df GROUP BY image_name) AS c GROUP BY n_labels
           UNION SELECT 0 AS n_labels, COUNT(*) AS n_images FROM (SELECT image_name FROM df GROUP BY image_name HAVING COUNT(*) = 1 AND any_value(label_name) = 'SMALL') AS u""",
    ),
    "distinct_pairs": ("SELECT DISTINCT label_name, set_type FROM df", None),
    "not_in_list": ("SELECT label_name, COUNT(DISTINCT image_name) AS n_images FROM df WHERE label_name NOT IN ('PROMO', 'SMALL') AND set_type IN ('F', 'O') GROUP BY label_name", None),
    "hashed_name": ("SELECT DISTINCT sha1(label_name) AS hashed FROM df", None),
    "average": ("SELECT ROUND(AVG(n_pixels), 6) AS mean FROM df", None),
    # means in whole millionths, so that no order of rows and no way of rounding plays a part
    "superpixel_bound": (
        "SELECT subject_name, CAST((2 * SUM(CAST(ROUND(dice * 1000000) AS BIGINT)) + COUNT(*)) / (2 * COUNT(*)) AS FLOAT) / 1000000 AS bound, CAST((2000000 * SUM(n_pixels) + COUNT(*)) / (2 * COUNT(*)) AS FLOAT) / 1000000 AS pixels, CAST((2 * SUM(CAST(ROUND(dice * 1000000) AS BIGINT) * n_pixels) + COUNT(*)) / (2 * COUNT(*)) AS FLOAT) / 1000000 AS weighted FROM df GROUP BY subject_name",
        "SELECT subject_name, CAST((2 * SUM(CAST(ROUND(dice * 1000000) AS BIGINT)) + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 1000000 AS bound, CAST((2000000 * SUM(n_pixels) + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 1000000 AS pixels, CAST((2 * SUM(CAST(ROUND(dice * 1000000) AS BIGINT) * n_pixels) + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 1000000 AS weighted FROM df GROUP BY subject_name",
    ),
    "test_labels": ("SELECT COUNT(DISTINCT label_name) AS n_labels FROM df WHERE is_test = 1 AND label_name != 'PROMO'", "SELECT COUNT(DISTINCT label_name) AS n_labels FROM df WHERE is_test AND label_name != 'PROMO'"),
    "background_share": (
        "SELECT ROUND(CAST(SUM(CASE WHEN label_name = 'PROMO' THEN n_pixels ELSE 0 END) AS FLOAT) / SUM(n_pixels), 6) AS share FROM df",
        "SELECT ROUND(CAST(SUM(CASE WHEN label_name = 'PROMO' THEN n_pixels ELSE 0 END) AS DOUBLE) / SUM(n_pixels), 6) AS share FROM df",
    ),
    "invalid_share": (
        "SELECT is_test, ROUND(CAST(SUM(n_pixels) AS FLOAT) / COUNT(DISTINCT image_name), 6) AS pixels FROM df WHERE label_name = 'SMALL' AND is_test = 0 GROUP BY is_test",
        "SELECT CAST(is_test AS INTEGER) AS is_test, ROUND(CAST(SUM(n_pixels) AS DOUBLE) / COUNT(DISTINCT image_name), 6) AS pixels FROM df WHERE label_name = 'SMALL' AND NOT is_test GROUP BY is_test",
    ),
    "test_label_list": (
        "SELECT subject_name, GROUP_CONCAT(DISTINCT label_name) AS labels FROM df WHERE is_test = 1 AND label_name NOT IN ('PROMO') GROUP BY subject_name",
        "SELECT subject_name, string_agg(DISTINCT label_name, ',' ORDER BY label_name) AS labels FROM df WHERE is_test AND label_name NOT IN ('PROMO') GROUP BY subject_name",
    ),
    "superpixel_means": ("SELECT label_name, ROUND(AVG(dice), 6) AS dice FROM df WHERE dice > 0.02 GROUP BY label_name", None),
    "one_subject_labels": (
        "SELECT image_name, subject_name, GROUP_CONCAT(DISTINCT label_name) AS labels FROM df GROUP BY image_name, subject_name HAVING COUNT(DISTINCT label_name) > 3",
        "SELECT image_name, subject_name, string_agg(DISTINCT label_name, ',' ORDER BY label_name) AS labels FROM df GROUP BY image_name, subject_name HAVING COUNT(DISTINCT label_name) > 3",
    ),
    "lone_columns": (
        """SELECT image_name, subject_name, is_test, COUNT(*) AS n_labels, GROUP_CONCAT(label_name) AS label_names FROM df WHERE is_test OR n_pixels > 100
           GROUP BY image_name ORDER BY subject_name""",
        """SELECT image_name, any_value(subject_name) AS subject_name, CAST(any_value(is_test) AS INTEGER) AS is_test, COUNT(*) AS n_labels,
           string_agg(label_name, ',' ORDER BY label_name) AS label_names FROM df WHERE is_test OR n_pixels > 100 GROUP BY image_name""",
    ),
    "quoted_names": (
        """SELECT label_name AS "label of the cells", SUM(n_pixels * 1.0) / COUNT(*) AS "mean pixels" FROM df WHERE NOT is_test AND label_name != "PROMO" GROUP BY label_name HAVING "mean pixels" > 20.5""",
        """SELECT label_name AS "label of the cells", SUM(CAST(n_pixels AS DOUBLE)) / COUNT(*) AS "mean pixels" FROM df WHERE NOT is_test AND label_name <> 'PROMO' GROUP BY label_name HAVING SUM(CAST(n_pixels AS DOUBLE)) / COUNT(*) > 20.5""",
    ),
    "flag_counts": (
        "SELECT label_name, SUM(is_test) AS n_test, COUNT(CASE WHEN is_test AND n_pixels > 30 THEN 1 END) AS n_large, MAX(is_test) AS any_test FROM df WHERE NOT (is_test AND n_pixels < 10) GROUP BY label_name",
        "SELECT label_name, CAST(SUM(CAST(is_test AS INTEGER)) AS BIGINT) AS n_test, COUNT(CASE WHEN is_test AND n_pixels > 30 THEN 1 END) AS n_large, MAX(CAST(is_test AS INTEGER)) AS any_test FROM df WHERE NOT (is_test AND n_pixels < 10) GROUP BY label_name",
    ),
    "label_distribution": ("SELECT label_name, CAST(SUM(n_pixels) AS BIGINT) AS n_pixels, COUNT(DISTINCT image_name) AS n_images FROM df WHERE label_name NOT IN ('MEDIUM') GROUP BY label_name ORDER BY n_pixels DESC", "SELECT label_name, CAST(SUM(n_pixels) AS BIGINT) AS n_pixels, COUNT(DISTINCT image_name) AS n_images FROM df WHERE label_name NOT IN ('MEDIUM') GROUP BY label_name"),
    "label_distribution_by_set": ("SELECT set_type, label_name, CAST(SUM(n_pixels) AS BIGINT) AS n_pixels FROM df WHERE label_name NOT IN ('MEDIUM') GROUP BY set_type, label_name", None),
    "single_label_images": (
        "SELECT image_name, COUNT(*) AS n FROM df GROUP BY image_name HAVING n = 1",
        "SELECT image_name, COUNT(*) AS n FROM df GROUP BY image_name HAVING COUNT(*) = 1",
    ),
    "subjects_of_images": ("SELECT subject_name, COUNT(DISTINCT image_name) AS n_images FROM df WHERE set_type IN ('F', 'O') GROUP BY subject_name ORDER BY n_images", "SELECT subject_name, COUNT(DISTINCT image_name) AS n_images FROM df WHERE set_type IN ('F', 'O') GROUP BY subject_name"),
    "label_coverage": ("SELECT label_name, COUNT(DISTINCT subject_name) AS n_subjects FROM df WHERE set_type = 'O' GROUP BY label_name HAVING n_subjects >= 2 ORDER BY n_subjects", "SELECT label_name, COUNT(DISTINCT subject_name) AS n_subjects FROM df WHERE set_type = 'O' GROUP BY label_name HAVING COUNT(DISTINCT subject_name) >= 2"),
    "aggregate_division": (
        "SELECT df.label_name, SUM(df.n_pixels) / COUNT(*) AS whole_mean, COUNT(DISTINCT image_name) / 2 AS half, (MAX(n_pixels) + 1) / 3 AS third, 'a/b' AS plain, ROUND(AVG(n_pixels) / 2, 6) AS mean_half FROM df WHERE df.label_name <> 'a/b' GROUP BY df.label_name",
        "SELECT df.label_name, CAST(SUM(df.n_pixels) // COUNT(*) AS BIGINT) AS whole_mean, COUNT(DISTINCT image_name) // 2 AS half, (MAX(n_pixels) + 1) // 3 AS third, 'a/b' AS plain, ROUND(AVG(n_pixels) / 2, 6) AS mean_half FROM df WHERE df.label_name <> 'a/b' GROUP BY df.label_name",
    ),
}


def _query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql(text, {"df": stats(spark, sf_dir)})

    return run


QUERIES = {f"sql_{name}": (_query(text), STATS + (other or text.replace("==", "="))) for name, (text, other) in STATEMENTS.items()}
