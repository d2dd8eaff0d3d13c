"""Hierarchical metrics, confusion matrices and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import metrics as M
from ..session import tables
from .corpus import orders_of

_IMAGES = """
WITH rows AS (
    SELECT c_nationkey AS domain, o_custkey AS subject_name, o_orderkey AS image_name, p_type AS used_labels, avg(round(l_discount * 100)) AS dice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
    GROUP BY c_nationkey, o_custkey, o_orderkey, p_type
)
"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an image with parallel arrays of labels and metrics, in whole per cent: a rounded mean of
    means of whole numbers depends on the order of summation only in rare ties of the last digit."""
    t = tables(spark, sf_dir, "lineitem", "orders", "customer", "part")
    # customers meet their orders first, so line items are dealt once
    orders = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = orders_of(t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")), orders, t["lineitem"].count())
    one = rows.groupBy(F.col("c_nationkey").alias("domain"), F.col("o_custkey").alias("subject_name"), F.col("o_orderkey").alias("image_name"), F.col("p_type").alias("used_labels")).agg(F.avg(F.round(F.col("l_discount") * 100)).alias("dice"))
    return A.implode(one, ["domain", "subject_name", "image_name"], "used_labels", ["used_labels", "dice"])


def hier_class_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.grouped_metrics(images(spark, sf_dir), ["dice"])
    return out.select("used_labels", F.round("dice", 9).alias("dice"))


def hier_image_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.grouped_metrics(images(spark, sf_dir), ["dice"], mode="image_level")
    return out.select("subject_name", F.round("dice", 9).alias("dice"))


def hier_domain_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.grouped_metrics(images(spark, sf_dir), ["dice"], domains=["domain"])
    return out.select("domain", "used_labels", F.round("dice", 9).alias("dice"))


def hier_checkpoint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.checkpoint_score(images(spark, sf_dir), "dice", "domain").select(F.round("dice", 9).alias("dice"))


_LABELS = "WITH cells AS (SELECT lang, source, quality AS i, toxic AS j, d.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "labels", "documents")
    return t["labels"].join(t["documents"].select("doc_id", "lang", "source"), "doc_id").select("lang", "source", F.col("quality").alias("label"), F.col("toxic").alias("prediction"), "doc_id")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(cells(spark, sf_dir), ["lang"], 3)


def matrix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of 2 x 2 matrices, one a document, by language, as text."""
    one = lambda i, j: F.when((F.col("label") == i) & (F.col("prediction") == j), 1).otherwise(0).cast("long")
    rows = cells(spark, sf_dir).select("lang", F.array(F.array(one(0, 0), one(0, 1)), F.array(one(1, 0), one(1, 1))).alias("m"))
    return A.matrix_sum(rows, ["lang"], "m").select("lang", F.array_join(F.transform(F.flatten("m"), lambda x: x.cast("string")), ",").alias("m"))


def cm_row_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.normalised_confusion(M.confusion(cells(spark, sf_dir), ["source"], 2), "source")
    return out.select("i", "j", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def dice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = M.confusion(cells(spark, sf_dir), ["lang"], 2)
    out = M.dice_from_confusion(counts, ["lang"]).join(M.accuracy_from_confusion(counts, ["lang"]), "lang")
    return out.select("lang", "label", F.round("dice", 6).alias("dice"), F.round("accuracy", 6).alias("accuracy"))


def samples_of_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.samples_from_confusion(M.confusion(cells(spark, sf_dir), ["lang"], 2), ["lang"])
    return rows.groupBy("lang", "label", "prediction").agg(F.count("*").alias("n"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions: the discount's tenfold as confidence, the flags as label and prediction."""
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    label, prediction = (F.when(F.col(c) == v, 1).otherwise(0) for c, v in (("l_returnflag", "N"), ("l_linestatus", "O")))
    return li.select(F.col("l_suppkey").alias("subject"), label.alias("label"), prediction.alias("prediction"), (F.round(F.col("l_quantity")) / 50).alias("confidence"), (F.col("l_linenumber") != 3).alias("valid"))


_SCORED = """
WITH s AS (
    SELECT l_suppkey AS subject, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS label, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS prediction,
           round(l_quantity) / 50 AS confidence, l_linenumber <> 3 AS valid
    FROM lineitem
)
"""


def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    out = M.calibration_bins(s, [], 10, "confidence", F.col("label") == F.col("prediction"))
    return out.select("bin", "n", F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"), F.round(F.col("confidence") / F.col("n"), 6).alias("confidence"))


def ece_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    binned = M.calibration_bins(s, ["subject"], 10, "confidence", F.col("label") == F.col("prediction"))
    return M.calibration_error(binned, []).select(F.round("error", 6).alias("error"))


def brier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    two = M.brier(F.array(1 - F.col("confidence"), F.col("confidence")), F.col("label"))
    three = M.brier(F.array((1 - F.col("confidence")) / 2, F.col("confidence"), (1 - F.col("confidence")) / 2), F.col("label"))
    return s.agg(F.round(F.avg(two), 6).alias("binary"), F.round(F.avg(three), 6).alias("multiclass"))


def dice_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.dice_at_thresholds(_scored(spark, sf_dir), [], [0.1, 0.5, 0.9])
    return out.select("threshold", "label", F.round("area", 6).alias("area"), F.round("dice", 6).alias("dice"))


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.roc(_scored(spark, sf_dir), [], "confidence", "label", 51)
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auroc(_scored(spark, sf_dir), ["prediction"], "confidence", "label").select("prediction", F.round("auc", 6).alias("auc"))


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.average_precision(_scored(spark, sf_dir), ["prediction"], "confidence", "label")
    return out.select("prediction", F.round("average_precision", 6).alias("average_precision"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables(spark, sf_dir, "part")["part"].groupBy(F.col("p_type").alias("label_index")).agg(F.count("*").alias("n"))
    out = A.class_weights(counts)
    return out.select("label_index", *[F.round(c, 6).alias(c) for c in ("one", "share", "inverse", "softmin", "nll")])


def superpixel_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables(spark, sf_dir, "lineitem")["lineitem"].select(F.lit(1).alias("image"), F.col("l_suppkey").alias("superpixel"), F.col("l_linenumber").alias("label"), F.col("l_quantity").alias("q"))
    return M.superpixels(li, ["image"], "superpixel", "label", F.col("q") > 20).select("superpixel", "label", "n")


def surface_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface scores of images: one a supplier, its line items as cells."""
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    flag = lambda c, v: F.when(F.col(c) == v, 1).otherwise(0)
    grid = li.groupBy(F.col("l_suppkey").alias("image_name"), F.pmod("l_orderkey", F.lit(16)).cast("int").alias("row"), F.pmod("l_partkey", F.lit(16)).cast("int").alias("col"))
    cells_ = grid.agg(F.max(flag("l_returnflag", "N")).alias("label"), F.max(flag("l_linestatus", "O")).alias("prediction")).withColumn("valid", F.lit(True))
    out = M.surface_scores(cells_)
    return out.select("image_name", "label", F.round("nsd", 6).alias("nsd"), F.round("asd", 6).alias("asd"))


def image_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, mean dice and calibration error of each image, in one call; suppliers stand for images."""
    cells_ = _scored(spark, sf_dir).withColumnRenamed("subject", "image_name")
    out = M.evaluate_images(cells_, "image_name", 2, "confidence")
    return out.select("image_name", F.round("accuracy", 6).alias("accuracy"), F.round("dice_mean", 6).alias("dice_mean"), F.round("error", 6).alias("error"))


def domain_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "orders", "customer")
    rows = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").alias("subject"), F.col("o_orderkey").alias("image"), F.col("o_orderstatus").alias("t"), F.when(F.col("o_orderpriority").startswith("1"), "O").otherwise("F").alias("p"))
    return A.domain_accuracy(rows, "t", "p", "subject", "image").select("subject", F.round("accuracy", 6).alias("accuracy"))


_GRID = ", g AS (SELECT lang, a.i, b.j FROM (SELECT DISTINCT lang FROM cells) k, (VALUES (0), (1), (2)) a(i), (VALUES (0), (1), (2)) b(j))"
_BIN = "least(9, greatest(0, CAST(ceil(confidence * 10 - 1e-9) AS INTEGER) - 1))"

QUERIES = {
    "hier_class_mean": (hier_class_mean, _IMAGES + ", s AS (SELECT subject_name, used_labels, avg(dice) AS dice FROM rows GROUP BY ALL) SELECT used_labels, round(avg(dice), 9) AS dice FROM s GROUP BY used_labels"),
    "hier_image_mean": (hier_image_mean, _IMAGES + ", s AS (SELECT subject_name, image_name, avg(dice) AS dice FROM rows GROUP BY ALL) SELECT subject_name, round(avg(dice), 9) AS dice FROM s GROUP BY subject_name"),
    "hier_domain_mean": (hier_domain_mean, _IMAGES + ", s AS (SELECT domain, subject_name, used_labels, avg(dice) AS dice FROM rows GROUP BY ALL) SELECT domain, used_labels, round(avg(dice), 9) AS dice FROM s GROUP BY domain, used_labels"),
    "hier_checkpoint_score": (hier_checkpoint_score, _IMAGES + ", s AS (SELECT domain, subject_name, used_labels, avg(dice) AS dice FROM rows GROUP BY ALL), d AS (SELECT domain, used_labels, avg(dice) AS dice FROM s GROUP BY ALL), l AS (SELECT used_labels, avg(dice) AS dice FROM d GROUP BY ALL) SELECT round(avg(dice), 9) AS dice FROM l"),
    "confusion_matrix": (confusion_matrix, _LABELS + _GRID + " SELECT g.lang, g.i, g.j, count(doc_id) AS n FROM g LEFT JOIN cells c ON g.lang = c.lang AND g.i = c.i AND g.j = c.j GROUP BY ALL"),
    "matrix_sums": (matrix_sums, _LABELS + " SELECT lang, concat_ws(',', count(*) FILTER (i = 0 AND j = 0), count(*) FILTER (i = 0 AND j = 1), count(*) FILTER (i = 1 AND j = 0), count(*) FILTER (i = 1 AND j = 1)) AS m FROM cells GROUP BY lang"),
    "cm_row_normalised": (
        cm_row_normalised,
        _LABELS + ", t AS (SELECT source, i, count(*) AS t FROM cells GROUP BY ALL), s AS (SELECT t.source, t.i, b.j, count(c.doc_id) / any_value(t.t) AS s FROM t CROSS JOIN (VALUES (0), (1)) b(j) LEFT JOIN cells c ON c.source = t.source AND c.i = t.i AND c.j = b.j GROUP BY ALL) SELECT i, j, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std FROM s GROUP BY i, j",
    ),
    "dice_accuracy": (
        dice_accuracy,
        _LABELS + ", a AS (SELECT lang, avg(CAST(i = j AS INTEGER)) AS accuracy FROM cells GROUP BY lang) SELECT c.lang, k.label, round(2 * count(*) FILTER (i = label AND j = label) / (count(*) FILTER (i = label) + count(*) FILTER (j = label)), 6) AS dice, round(any_value(accuracy), 6) AS accuracy FROM cells c JOIN a ON a.lang = c.lang CROSS JOIN (VALUES (0), (1)) k(label) GROUP BY c.lang, k.label HAVING count(*) FILTER (i = label) > 0",
    ),
    "samples_of_confusion": (samples_of_confusion, _LABELS + " SELECT lang, i AS label, j AS prediction, count(*) AS n FROM cells GROUP BY ALL"),
    "ece_bins": (ece_bins, _SCORED + f" SELECT {_BIN} AS bin, count(*) AS n, round(avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy, round(avg(confidence), 6) AS confidence FROM s GROUP BY 1"),
    "ece_error": (ece_error, _SCORED + f", b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(CAST(label = prediction AS INTEGER)) AS a, avg(confidence) AS c FROM s GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS error FROM b"),
    "brier_scores": (
        brier_scores,
        _SCORED + " SELECT round(avg((confidence - label) * (confidence - label)), 6) AS \"binary\", round(avg(((1 - confidence) / 2 - CAST(label = 0 AS INTEGER)) ** 2 + (confidence - CAST(label = 1 AS INTEGER)) ** 2 + ((1 - confidence) / 2) ** 2), 6) AS multiclass FROM s",
    ),
    "dice_thresholds": (
        dice_thresholds,
        _SCORED
        + """, t AS (SELECT threshold, c.label AS label, count(*) FILTER (s.label = c.label) AS a, count(*) FILTER (s.label = c.label AND ok) AS r, count(*) FILTER (s.prediction = c.label AND ok) AS p,
             count(*) FILTER (s.label = c.label AND s.prediction = c.label AND ok) AS h
             FROM (SELECT *, threshold, valid AND confidence >= threshold AS ok FROM s, (VALUES (0.1::DOUBLE), (0.5), (0.9)) v(threshold)) s, (VALUES (0), (1)) c(label) GROUP BY ALL)
             SELECT threshold, label, round(r / a, 6) AS area, round(CASE WHEN r > 0 THEN 2 * h / (r + p) ELSE 'nan'::DOUBLE END, 6) AS dice FROM t WHERE a > 0""",
    ),
    "roc_curve": (
        roc_curve,
        _SCORED + ", g AS (SELECT CAST(unnest(range(51)) AS INTEGER) AS b) SELECT round(b / 50, 6) AS threshold, round(count(*) FILTER (label = 1 AND round(confidence * 50) >= b) / count(*) FILTER (label = 1), 6) AS tpr, round(count(*) FILTER (label = 0 AND round(confidence * 50) >= b) / count(*) FILTER (label = 0), 6) AS fpr FROM s, g GROUP BY b",
    ),
    "auroc": (
        auroc,
        _SCORED + ", r AS (SELECT prediction, label, rank() OVER w + (count(*) OVER (PARTITION BY prediction, confidence) - 1) / 2.0 AS k FROM s WINDOW w AS (PARTITION BY prediction ORDER BY confidence)), n AS (SELECT prediction, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS q, sum(CASE WHEN label = 1 THEN k END) AS k FROM r GROUP BY 1) SELECT prediction, CASE WHEN p * q > 0 THEN round((k - p * (p + 1) / 2) / (p * q), 6) END AS auc FROM n",
    ),
    "average_precision": (
        average_precision,
        _SCORED + ", c AS (SELECT prediction, confidence, sum(label) AS p, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT prediction, p, sum(p) OVER w AS tp, sum(n) OVER w AS hits FROM c WINDOW w AS (PARTITION BY prediction ORDER BY confidence DESC)) SELECT prediction, CASE WHEN sum(p) > 0 THEN round(CAST(sum(p * tp / hits) / sum(p) AS DOUBLE), 6) END AS average_precision FROM t GROUP BY 1",
    ),
    "class_weights": (
        class_weights,
        "WITH c AS (SELECT p_type AS label_index, count(*) AS n FROM part GROUP BY 1), s AS (SELECT label_index, n, n / sum(n) OVER () AS s FROM c) SELECT label_index, CAST(1 AS DOUBLE) AS one, round((1 - s) / sum(1 - s) OVER (), 6) AS share, round((1 / n) / sum(1 / n) OVER (), 6) AS inverse, round(exp(-2 * s) / sum(exp(-2 * s)) OVER (), 6) AS softmin, round(-ln(s), 6) AS nll FROM s",
    ),
    "superpixel_mode": (
        superpixel_mode,
        "WITH c AS (SELECT l_suppkey AS superpixel, l_linenumber AS label, count(*) AS n FROM lineitem WHERE l_quantity > 20 GROUP BY ALL), m AS (SELECT superpixel, label, row_number() OVER (PARTITION BY superpixel ORDER BY n DESC, label) AS k, CAST(sum(n) OVER (PARTITION BY superpixel) AS BIGINT) AS n FROM c) SELECT s.superpixel, coalesce(label, 0) AS label, coalesce(n, 0) AS n FROM (SELECT DISTINCT l_suppkey AS superpixel FROM lineitem) s LEFT JOIN m ON m.superpixel = s.superpixel AND k = 1",
    ),
    "surface_scores": (
        surface_scores,
        """WITH c AS (SELECT l_suppkey AS image_name, CAST(l_orderkey % 16 AS INTEGER) AS r, CAST(l_partkey % 16 AS INTEGER) AS k,
             max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS a, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS b FROM lineitem GROUP BY ALL),
           m AS (SELECT image_name, r, k, a AS label, 'a' AS side FROM c UNION ALL SELECT image_name, r, k, b, 'b' FROM c),
           border AS (SELECT m.* FROM m LEFT JOIN m n ON n.image_name = m.image_name AND n.side = m.side AND n.label = m.label AND abs(n.r - m.r) + abs(n.k - m.k) = 1
                      GROUP BY ALL HAVING count(n.r) < 4),
           named AS (SELECT DISTINCT image_name, a AS label FROM c),
           d AS (SELECT p.image_name, p.label, p.side, p.r, p.k, min(sqrt((p.r - q.r) * (p.r - q.r) + (p.k - q.k) * (p.k - q.k))) AS d
                 FROM border p JOIN named USING (image_name, label) LEFT JOIN border q ON q.image_name = p.image_name AND q.label = p.label AND q.side <> p.side GROUP BY ALL),
           w AS (SELECT image_name, max(d) AS worst FROM d GROUP BY 1), s AS (SELECT image_name, sqrt((max(r) + 1) * (max(r) + 1) + (max(k) + 1) * (max(k) + 1)) AS diagonal FROM c GROUP BY 1)
           SELECT d.image_name, d.label, round(count(*) FILTER (d <= 1) / count(*), 6) AS nsd, round(avg(coalesce(d, worst, diagonal)), 6) AS asd
           FROM d JOIN w USING (image_name) JOIN s USING (image_name) GROUP BY 1, 2""",
    ),
    "image_evaluation": (
        image_evaluation,
        _SCORED
        + f""", v AS (SELECT * FROM s WHERE valid), a AS (SELECT subject, avg(CAST(label = prediction AS INTEGER)) AS accuracy FROM v GROUP BY 1),
             d AS (SELECT subject, c.c, 2 * count(*) FILTER (label = c AND prediction = c) / (count(*) FILTER (label = c) + count(*) FILTER (prediction = c)) AS dice FROM v, (VALUES (0), (1)) c(c) GROUP BY ALL HAVING count(*) FILTER (label = c) > 0),
             m AS (SELECT subject, avg(dice) AS dice_mean FROM d GROUP BY 1),
             b AS (SELECT subject, {_BIN} AS bin, count(*) AS n, avg(CAST(label = prediction AS INTEGER)) AS h, avg(confidence) AS c FROM v GROUP BY ALL), e AS (SELECT subject, sum(n * abs(h - c)) / sum(n) AS error FROM b GROUP BY 1)
             SELECT a.subject AS image_name, round(accuracy, 6) AS accuracy, round(dice_mean, 6) AS dice_mean, round(error, 6) AS error FROM a JOIN m USING (subject) JOIN e USING (subject)""",
    ),
    "domain_accuracy": (domain_accuracy, "SELECT c_nationkey AS subject, round(avg(CAST(o_orderstatus = CASE WHEN starts_with(o_orderpriority, '1') THEN 'O' ELSE 'F' END AS INTEGER)), 6) AS accuracy FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
}
