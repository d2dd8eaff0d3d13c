"""Composite queries: cohorts, ensembles, comparisons, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..operators import composites as Q
from ..session import tables
from .corpus import STATS, stats


def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "customer", "supplier", "nation")
    first = t["customer"].where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("name"))
    second = t["supplier"].groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name"))
    return Q.lookup(t["nation"].select(F.col("n_nationkey").alias("k")), [first, second], "k", "name")


def image_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats(spark, sf_dir).groupBy("image_name").agg(F.collect_set("label_name").alias("labels"))
    return s.where(Q.has_labels(F.col("labels"), 3) & Q.has_any_label(F.col("labels"), ["PROMO", "SMALL"])).select("image_name")


def cohort_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables(spark, sf_dir, "orders")["orders"].withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return Q.first_inclusion(o, "o_custkey", "o_orderdate", "status").select("o_custkey", "o_orderkey")


def cohort_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables(spark, sf_dir, "orders")["orders"]
    mine = o.where("o_orderstatus = 'P'").select("o_custkey").distinct()
    return Q.without_overlap(mine, [o.where("o_totalprice > 400000"), o.where("o_orderpriority = '1-URGENT'")], ["o_custkey"])


def cohort_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "lineitem", "part")
    rows = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("subject"), F.col("p_type").alias("label"), F.col("l_returnflag").alias("phase"), "l_quantity")
    out = Q.baseline_difference(rows, "subject", "label", "phase", "A", "l_quantity")
    return out.groupBy("subject", "label").agg(F.round(F.sum("difference"), 4).alias("difference"))


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    out = Q.comparison_table({"a": li.where("l_linestatus = 'O'"), "b": li.where("l_linestatus = 'F'")}, ["l_linenumber"], "l_discount")
    return out.select("l_linenumber", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def ensemble_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir, "embeddings")["embeddings"].select(F.col("label").alias("image"), V.doubles("embedding").alias("logits"))
    return Q.ensemble(e, ["image"], "logits").select("image", "prediction")


def ensemble_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir, "embeddings")["embeddings"].select(F.col("label").alias("image"), V.doubles("embedding").alias("logits"))
    return Q.ensemble(e, ["image"], "logits", "mode").select("image", "prediction")


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "labels", "documents")
    rows = t["labels"].join(t["documents"].select("doc_id", "source"), "doc_id")
    out = Q.binary_scores(rows, ["source"], "quality", "toxic")
    return out.select("source", *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "balanced_accuracy", "prevalence")])


def sampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats(spark, sf_dir)
    weights = s.groupBy("label_name").agg((1 / F.countDistinct("image_name")).alias("weight"))
    return Q.sampling_weights(s, "image_name", "label_name", weights).select("image_name", F.round("weight", 8).alias("weight"))


def neighbour_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reading import neighbour_matrix

    counts = neighbour_matrix(spark, sf_dir).withColumn("subject", F.col("image") % 3)
    return Q.neighbour_shares(counts, "subject", "image").select("of", "label", F.round("share", 6).alias("share"))


def relative_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import relative_change

    rows = tables(spark, sf_dir, "lineitem")["lineitem"]
    out = relative_change(rows, ["l_linenumber"], "l_quantity", F.col("l_returnflag") == "A")
    return out.groupBy("l_linenumber").agg(F.round(F.avg("change"), 6).alias("change"))


def table_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables(spark, sf_dir, "lineitem")["lineitem"].select(F.col("l_returnflag").alias("fold_name"), F.col("l_linenumber").alias("epoch_index"), F.lit(7).alias("best_epoch_index"), F.col("l_orderkey").alias("image_name"))
    return Q.consistency(li, []).groupBy("check").agg(F.count("*").alias("n"))


def rater_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two annotators agree on the cells of an image that both have marked."""
    from ..operators.metrics import annotator_pairs

    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    keys = [F.col("l_suppkey").alias("image_name"), F.col("l_linestatus").alias("annotation_name"), F.pmod("l_orderkey", F.lit(20)).cast("int").alias("row"), F.pmod("l_partkey", F.lit(20)).cast("int").alias("col")]
    cells = li.groupBy(*keys).agg(F.min("l_linenumber").alias("label"))
    out = annotator_pairs(cells).groupBy("image_name", "first", "second")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("same"))


def interval_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links followed from one table of paths to another."""
    o = tables(spark, sf_dir, "orders")["orders"]
    paths = o.select(F.col("o_orderkey").cast("string").alias("path"))
    links = o.select(F.col("o_orderkey").cast("string").alias("from"), F.col("o_custkey").cast("string").alias("to"))
    return Q.follow_links(paths, links)


QUERIES = {
    "lookup_fallback": (lookup_fallback, "SELECT n_nationkey AS k, coalesce(a, b) AS name FROM nation LEFT JOIN (SELECT c_nationkey, min(c_name) AS a FROM customer WHERE c_acctbal > 5000 GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, min(s_name) AS b FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"),
    "image_filters": (image_filters, STATS + " SELECT image_name FROM df GROUP BY image_name HAVING count(DISTINCT label_name) >= 3 AND bool_or(label_name IN ('PROMO', 'SMALL'))"),
    "cohort_inclusion": (cohort_inclusion, "SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS r FROM orders WHERE o_orderstatus <> 'P') WHERE r = 1"),
    "cohort_overlap": (cohort_overlap, "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 OR o_orderpriority = '1-URGENT')"),
    "cohort_difference": (cohort_difference, "WITH r AS (SELECT l_suppkey AS subject, p_type AS label, l_returnflag AS phase, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey), e AS (SELECT subject, label, avg(q) AS m FROM r WHERE phase = 'A' GROUP BY ALL), g AS (SELECT label, avg(q) AS m FROM r WHERE phase = 'A' GROUP BY ALL) SELECT r.subject, r.label, round(sum(q - coalesce(e.m, g.m)), 4) + 0.0 AS difference FROM r LEFT JOIN e ON e.subject = r.subject AND e.label = r.label LEFT JOIN g ON g.label = r.label GROUP BY ALL"),
    "model_comparison": (model_comparison, "SELECT l_linenumber, round(avg(l_discount) FILTER (l_linestatus = 'O'), 6) AS a, round(avg(l_discount) FILTER (l_linestatus = 'F'), 6) AS b FROM lineitem GROUP BY 1"),
    "ensemble_predictions": (ensemble_predictions, "WITH m AS (SELECT label AS image, i - 1 AS c, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i) GROUP BY ALL) SELECT image, CAST(arg_max(c, x) AS INTEGER) AS prediction FROM m GROUP BY image"),
    "ensemble_mode": (ensemble_mode, "WITH p AS (SELECT label AS image, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS c FROM embeddings), n AS (SELECT image, c, row_number() OVER (PARTITION BY image ORDER BY count(*) DESC, c) AS k FROM p GROUP BY image, c) SELECT image, c AS prediction FROM n WHERE k = 1"),
    "binary_scores": (binary_scores, "WITH c AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY 1), r AS (SELECT source, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS a, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS b, (tp + fn) / (tp + fn + fp + tn) AS p FROM c) SELECT source, round(a, 6) AS sensitivity, round(b, 6) AS specificity, round((a + b) / 2, 6) AS balanced_accuracy, round(p, 6) AS prevalence FROM r"),
    "sampling_weights": (sampling_weights, STATS + ", w AS (SELECT label_name, 1 / count(DISTINCT image_name) AS w FROM df GROUP BY 1) SELECT image_name, round(avg(w), 8) AS weight FROM df JOIN w USING (label_name) GROUP BY 1"),
    "neighbour_shares": (
        neighbour_shares,
        "WITH c AS (SELECT l_suppkey AS image, CAST(l_orderkey % 25 AS INTEGER) AS r, CAST(l_partkey % 25 AS INTEGER) AS k, min(l_linenumber) AS label FROM lineitem GROUP BY ALL), p AS (SELECT DISTINCT a.image, a.label AS o, b.r, b.k, b.label FROM c a JOIN c b ON a.image = b.image AND abs(a.r - b.r) <= 1 AND abs(a.k - b.k) <= 1 AND a.label <> b.label), n AS (SELECT image, image % 3 AS subject, o, label, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT *, 100 * n / sum(n) OVER (PARTITION BY image, o) AS share FROM n), i AS (SELECT subject, o, count(DISTINCT image) AS images FROM s GROUP BY ALL), u AS (SELECT s.subject, s.o, label, sum(share) / any_value(images) AS share FROM s JOIN i ON s.subject = i.subject AND s.o = i.o GROUP BY ALL), t AS (SELECT o, count(*) AS subjects FROM i GROUP BY 1) SELECT u.o AS \"of\", label, round(sum(share) / any_value(subjects), 6) AS share FROM u JOIN t ON u.o = t.o GROUP BY ALL",
    ),
    "relative_changes": (relative_changes, "WITH b AS (SELECT l_linenumber, avg(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT l_linenumber, round(avg((l_quantity - m) / m), 6) + 0.0 AS change FROM lineitem JOIN b USING (l_linenumber) GROUP BY 1"),
    "table_consistency": (table_consistency, "WITH v AS (SELECT 'repeated key' AS c FROM (SELECT l_returnflag, l_linenumber, l_orderkey FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'epochs of unequal size' FROM (SELECT l_returnflag FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linenumber) GROUP BY 1 HAVING max(n) <> min(n)) UNION ALL SELECT 'best epoch missing' FROM (SELECT l_returnflag FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_linenumber = 7))) SELECT c AS \"check\", count(*) AS n FROM v GROUP BY 1"),
    "rater_pairs": (
        rater_pairs,
        "WITH c AS (SELECT l_suppkey AS image_name, l_linestatus AS a, l_orderkey % 20 AS r, l_partkey % 20 AS k, min(l_linenumber) AS label FROM lineitem GROUP BY ALL) SELECT x.image_name, x.a AS \"first\", y.a AS \"second\", count(*) AS n, count(*) FILTER (x.label = y.label) AS same FROM c x JOIN c y ON x.image_name = y.image_name AND x.r = y.r AND x.k = y.k AND x.a < y.a GROUP BY ALL",
    ),
    "linked_paths": (interval_neighbours, "SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders"),
}
