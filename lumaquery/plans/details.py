"""Single operators on the given tables: vectors, filters, cohorts, result tables, folds of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..operators import aggregates as A
from ..operators import cells as R
from ..operators import checks as C
from ..operators import composites as Q
from ..operators import metrics as M
from ..operators import surfaces as D
from ..sources import tables as T
from ..session import tables
from .corpus import orders_of

_E = "WITH e AS (SELECT vec_id, label, i - 1 AS idx, CAST(embedding[i] AS DOUBLE) AS x, len(embedding) AS n FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "embeddings")["embeddings"].select("vec_id", "label", V.doubles("embedding").alias("v"))


def _long(change: Callable[[Column], Column]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _vectors(spark, sf_dir).select("vec_id", F.posexplode(change(F.col("v"))).alias("idx", "x"))
        return out.select("vec_id", "idx", F.round("x", 6).alias("x"))

    return run


def vector_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors less the mean of all, over the deviation of all, place by place."""
    v = _vectors(spark, sf_dir)
    m = V.elementwise(v, [], "v").withColumnRenamed("v", "m")
    s = V.elementwise(v, [], "v", "std_pop").withColumnRenamed("v", "s")
    out = v.join(F.broadcast(m)).join(F.broadcast(s))  # one row each
    out = out.select("vec_id", F.posexplode(V.standardised(F.col("v"), F.col("m"), F.col("s"))).alias("idx", "x"))
    return out.select("vec_id", "idx", F.round("x", 6).alias("x"))


def median_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and deviations of each label's vectors with an even id, and of their first component as a parameter."""
    rows = _vectors(spark, sf_dir).withColumn("p", F.col("v")[0]).withColumn("used", F.col("vec_id") % 2 == 0)
    out = T.median_spectra(rows, ["label"], "v", ["p"], "used")
    out = out.select("label", "n_pixels", F.round("median_p", 6).alias("median_p"), F.round("std_p", 6).alias("std_p"), F.posexplode(F.arrays_zip("median_v", "std_v")).alias("idx", "x"))
    return out.select("label", "n_pixels", "median_p", "std_p", "idx", F.round("x.median_v", 6).alias("median_v"), F.round("x.std_v", 6).alias("std_v"))


def group_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of groups of labels, with a column that has one value a group."""
    rows = _vectors(spark, sf_dir).withColumn("kind", F.col("label") % 3).withColumn("half", F.col("label") % 3 > 1)
    out = T.group_median_spectra(rows, ["kind"], ["v"], constants=["half"])
    return out.select("kind", "half", "n_spectra", F.posexplode("v").alias("idx", "x")).select("kind", "half", "n_spectra", "idx", F.round("x", 6).alias("x"))


def repeated_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of three transformations of the vectors of each label: scaled by one more than the epoch."""
    change = lambda df, epoch: df.withColumn("v", F.transform(F.arrays_zip("v", F.array_repeat(epoch, F.size("v")).alias("k")), lambda s: s["v"] * (s["k"] + 1)))
    out = Q.repeated_transform(_vectors(spark, sf_dir), change, 3, ["label"], "v")
    return out.select("epoch_index", "label", F.posexplode("v").alias("idx", "x")).select("epoch_index", "label", "idx", F.round("x", 6).alias("x"))


def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose vectors are usable, plainly and strictly, and how many have a value above 0.3."""
    v = _vectors(spark, sf_dir)
    strict = R.cube_validity(v, "label", "v", strict=True).withColumnRenamed("valid", "strict")
    over = v.groupBy("label").agg(F.count_if(R.oversaturated(F.col("v"), 0.3)).alias("n_over"))
    return R.cube_validity(v, "label", "v").join(strict, "label").join(over, "label")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table with folds (return flags) and epochs (line numbers): one row an image and epoch, arrays by label."""
    t = tables(spark, sf_dir, "lineitem", "orders", "part")
    rows = orders_of(t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")), t["orders"], t["lineitem"].count())
    keys = [F.col("l_returnflag").alias("fold_name"), F.pmod("l_linenumber", F.lit(3)).alias("epoch_index"), F.col("o_custkey").alias("subject_name"), F.col("o_orderkey").alias("image_name")]
    one = rows.groupBy(*keys, F.col("p_type").alias("used_labels")).agg(F.avg(F.round(F.col("l_discount") * 100)).alias("dice"))
    best = F.when(F.col("fold_name") == "A", 0).when(F.col("fold_name") == "N", 1).otherwise(2)
    return A.implode(one, ["fold_name", "epoch_index", "subject_name", "image_name"], "used_labels", ["used_labels", "dice"]).withColumn("best_epoch_index", best)


_FOLDED = """
WITH rows AS (
    SELECT l_returnflag AS fold_name, l_linenumber % 3 AS epoch_index, o_custkey AS subject_name, o_orderkey AS image_name, p_type AS used_labels, avg(round(l_discount * 100)) AS dice,
           CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS best
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL
)
"""


def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.grouped_metrics(_folded(spark, sf_dir), ["dice"], best_epoch_only=False, per_epoch=True)
    return out.select("fold_name", "epoch_index", "used_labels", F.round("dice", 6).alias("dice"))


def best_epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.grouped_metrics(_folded(spark, sf_dir), ["dice"], domains=["fold_name"])
    return out.select("fold_name", "used_labels", F.round("dice", 6).alias("dice"))


def size_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by the number of subjects and the seed in a fold's name."""
    rows = _folded(spark, sf_dir).drop("best_epoch_index").withColumn("fold_name", F.format_string("fold_n=%d_seed=%d", F.col("epoch_index").cast("long") + 1, F.when(F.col("fold_name") == "A", 1).otherwise(0).cast("long"))).drop("epoch_index")
    out = Q.size_table(rows, ["dice"])
    return out.select("size", "seed", "used_labels", F.round("dice", 6).alias("dice"))


def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over customers of their orders' mean quantities, by nation."""
    t = tables(spark, sf_dir, "lineitem", "orders", "customer")
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    out = A.means(rows, ["l_quantity"], ["c_nationkey", "o_custkey", "o_orderkey"], ["c_nationkey", "o_custkey"], ["c_nationkey"])
    return out.select("c_nationkey", F.round("l_quantity", 6).alias("mean"))


def tolerance_over_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over suppliers of the upper quartile of their quantities."""
    out = A.reduced_tolerance(tables(spark, sf_dir, "lineitem")["lineitem"], "l_suppkey", "l_quantity", "q75")
    return out.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def matrix_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states against priorities as a matrix, rows and columns in reverse."""
    o = tables(spark, sf_dir, "orders")["orders"]
    counts = o.groupBy((F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("i"), F.pmod("o_custkey", F.lit(5)).cast("int").alias("j")).agg(F.count("*").alias("n"))
    order = spark.range(5).select(F.col("id").cast("int").alias("old"), (4 - F.col("id")).cast("int").alias("new"))
    return Q.permuted(counts, order)


def split_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the one split that their customer's segment has."""
    t = tables(spark, sf_dir, "orders", "customer")
    spec = t["customer"].select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "test").otherwise("train").alias("split_name"))
    return C.split_of(t["orders"].select("o_orderkey", "o_custkey"), spec, ["o_custkey"])


def validated_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' prices updated by those of finished orders, keys checked on both sides."""
    o = tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    new = o.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, "new").alias("o_orderpriority"))
    return C.update_validation(o.drop("o_orderstatus"), new, ["o_orderkey"])


def enough_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with more than three lines of at least 10 pieces that show both other flags."""
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    return C.large_enough(li, "l_orderkey", F.col("l_quantity") >= 10, 3).join(C.with_all_labels(li, "l_orderkey", "l_linestatus", ["F", "O"]), "l_orderkey")


def perfusion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' phases as states, cleared where the discount says so."""
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    out = Q.perfusion_state(li, "l_returnflag", {"A": "physiological", "R": "ischemic"}, clear=F.when(F.col("l_quantity") > 5, F.col("l_discount") > 0.05))
    return out.select("l_orderkey", "l_linenumber", "perfusion_state")


def in_situ_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose notes don't say otherwise."""
    o = tables(spark, sf_dir, "orders")["orders"]
    notes = F.when(F.col("o_orderstatus") != "P", F.create_map(F.lit("a"), F.col("o_totalprice") > 50000, F.lit("b"), F.col("o_orderpriority") != "5-LOW"))
    return o.select("o_orderkey", Q.in_situ(notes).alias("in_situ"))


def challenge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' metrics as one row a task, without missing values."""
    c = tables(spark, sf_dir, "customer")["customer"].select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("double")).otherwise(float("nan")).alias("nation"))
    return Q.challenge_table(c, ["c_custkey"], ["balance", "nation"])


def confidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of thresholds to areas and scores by label as rows."""
    li = tables(spark, sf_dir, "lineitem")["lineitem"].select("l_orderkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("label"), F.col("l_discount").alias("a"), F.col("l_tax").alias("d"))
    packed = A.implode(li, ["l_orderkey"], "label", ["label", "a", "d"])
    half = lambda c, k: F.transform(c, lambda x: x * k)
    pair = lambda k: F.struct(half("a", k).alias("areas"), half("d", k).alias("dice_metric"))
    rows = packed.select("l_orderkey", F.col("label").alias("used_labels"), F.create_map(F.lit(0.5), pair(1.0), F.lit(0.75), pair(0.5)).alias("c"))
    out = Q.confidences_table(rows, ["l_orderkey"], "c")
    return out.select("l_orderkey", "threshold", F.col("used_labels").alias("label"), F.round("area", 6).alias("area"), F.round("dice", 6).alias("dice"))


def eliminated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part kinds in the order in which the least mean size drops out, and the first of them."""
    part = tables(spark, sf_dir, "part")["part"]
    first = Q.least_important(part, "p_type", "p_size").withColumn("first", F.lit(True))
    out = Q.eliminated(part, "p_type", "p_size", "place").join(first, "p_type", "left")
    return out.select("p_type", "place", F.coalesce("first", F.lit(False)).alias("first"))


def rate_at_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each priority's curve the true positive rate where the false one is nearest to 0.2."""
    o = tables(spark, sf_dir, "orders")["orders"]
    rows = o.select("o_orderpriority", F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    out = Q.rate_at(M.roc(rows, ["o_orderpriority"], "score", "label", 21), ["o_orderpriority"])
    return out.select("o_orderpriority", F.round("tpr", 6).alias("tpr"))


def annotator_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of borders by label, from every supplier's cells as two annotators drew them."""
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    keys = [F.col("l_suppkey").alias("image_name"), F.pmod("l_orderkey", F.lit(12)).cast("int").alias("row"), F.pmod("l_partkey", F.lit(12)).cast("int").alias("col")]
    cells = li.groupBy(*keys).agg(F.when(F.min("l_linenumber") > 2, 1).otherwise(0).alias("label"), F.when(F.max("l_linenumber") > 5, 1).otherwise(0).alias("prediction"))
    out = D.border_distances(cells).groupBy("label")
    # squares are whole numbers, so their sums are exact
    return out.agg(F.count("*").alias("n"), F.sum(F.round(F.col("distance") * F.col("distance")).cast("long")).alias("squares"))


_BORDERS = """
WITH c AS (SELECT l_suppkey AS image, l_orderkey % 12 AS r, l_partkey % 12 AS k, CASE WHEN min(l_linenumber) > 2 THEN 1 ELSE 0 END AS a, CASE WHEN max(l_linenumber) > 5 THEN 1 ELSE 0 END AS b FROM lineitem GROUP BY ALL),
s AS (SELECT image, r, k, 'a' AS side, a AS label FROM c UNION ALL SELECT image, r, k, 'b', b FROM c),
n AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(dr, dk)),
i AS (SELECT x.image, x.r, x.k, x.side, x.label, count(y.image) AS m FROM s x CROSS JOIN n LEFT JOIN s y ON y.image = x.image AND y.side = x.side AND y.label = x.label AND y.r = x.r + dr AND y.k = x.k + dk GROUP BY ALL),
e AS (SELECT image, r, k, side, label FROM i WHERE m < 4),
d AS (SELECT p.image, p.label, p.side, p.r, p.k, min((p.r - q.r) * (p.r - q.r) + (p.k - q.k) * (p.k - q.k)) AS d FROM e p JOIN e q ON p.image = q.image AND p.label = q.label AND p.side <> q.side GROUP BY ALL)
SELECT CAST(label AS INTEGER) AS label, count(*) AS n, CAST(sum(d) AS BIGINT) AS squares FROM d GROUP BY label
"""

_ROC21 = """
WITH s AS (SELECT o_orderpriority AS p, least(o_totalprice / 500000, 1.0) AS s, o_orderstatus = 'F' AS y FROM orders),
t AS (SELECT k / 20.0 AS t, k FROM unnest(range(21)) u(k)),
c AS (SELECT p, t, count(*) FILTER (y AND floor(s * 20 + 1e-9) >= k) / count(*) FILTER (y) AS tpr, count(*) FILTER (NOT y AND floor(s * 20 + 1e-9) >= k) / count(*) FILTER (NOT y) AS fpr FROM s, t GROUP BY p, t, k)
SELECT p AS o_orderpriority, round(tpr, 6) AS tpr FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY abs(fpr - 0.2), fpr, tpr) AS r FROM c) WHERE r = 1
"""

QUERIES = {
    "vector_standardised": (vector_standardised, _E + " SELECT vec_id, CAST(idx AS INTEGER) AS idx, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) + 0.0 AS x FROM e WINDOW w AS (PARTITION BY idx)"),
    "vector_softmax": (_long(V.softmax), _E + " SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w), 6) AS x FROM e WINDOW w AS (PARTITION BY vec_id)"),
    "vector_stretched": (
        _long(lambda v: V.stretched(v, 100)),
        "WITH v AS (SELECT vec_id, embedding AS v, len(embedding) AS n FROM embeddings), p AS (SELECT vec_id, v, n, i, CAST(i AS DOUBLE) * (n - 1) / 99 AS place FROM v, unnest(range(100)) u(i)) SELECT vec_id, CAST(i AS INTEGER) AS idx, round(CAST(v[CAST(floor(place) AS BIGINT) + 1] AS DOUBLE) + (place - floor(place)) * (CAST(coalesce(v[CAST(floor(place) AS BIGINT) + 2], v[CAST(floor(place) AS BIGINT) + 1]) AS DOUBLE) - CAST(v[CAST(floor(place) AS BIGINT) + 1] AS DOUBLE)), 6) + 0.0 AS x FROM p",
    ),
    "vector_padded": (_long(lambda v: V.padded(v, 70, -1.0)), _E + " SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(x, 6) + 0.0 AS x FROM e UNION ALL SELECT vec_id, CAST(i AS INTEGER), -1.0 FROM embeddings, unnest(range(64, 70)) u(i)"),
    "vector_affine": (_long(lambda v: V.affine(v, [[i % 3 - 1.0, i % 5 / 4] for i in range(64)], [0.5, -2.0])), _E + " SELECT vec_id, 0 AS idx, round(sum(x * (idx % 3 - 1)) + 0.5, 6) + 0.0 AS x FROM e GROUP BY vec_id UNION ALL SELECT vec_id, 1, round(sum(x * (idx % 5) / 4.0) - 2, 6) + 0.0 FROM e GROUP BY vec_id"),
    "vector_absorption": (_long(lambda v: V.absorption(F.transform(v, lambda x: F.abs(x) + 1))), _E + " SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(-ln(abs(x) + 1), 6) + 0.0 AS x FROM e"),
    "vector_one_hot": (_long(lambda v: V.one_hot(V.argmax(v), 64, 0.1)), _E + " SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(CASE WHEN row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, idx) = 1 THEN 0.9 ELSE 0.1 / 63 END, 6) AS x FROM e"),
    "median_spectra": (
        median_spectra,
        _E + ", n AS (SELECT label, count(*) AS n_pixels FROM embeddings GROUP BY 1), p AS (SELECT label, round(median(CAST(embedding[1] AS DOUBLE)), 6) AS median_p, round(stddev_pop(CAST(embedding[1] AS DOUBLE)), 6) AS std_p FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1), m AS (SELECT label, idx, round(median(x), 6) + 0.0 AS median_v, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(x) END, 6) AS std_v FROM e WHERE vec_id % 2 = 0 GROUP BY 1, 2) SELECT label, n_pixels, median_p, std_p, CAST(idx AS INTEGER) AS idx, median_v, std_v FROM m JOIN n USING (label) JOIN p USING (label)",
    ),
    "group_spectra": (group_spectra, _E + ", n AS (SELECT label % 3 AS kind, count(*) AS n_spectra FROM embeddings GROUP BY 1) SELECT kind, kind > 1 AS half, n_spectra, CAST(idx AS INTEGER) AS idx, round(avg(x), 6) + 0.0 AS x FROM e JOIN n ON label % 3 = kind GROUP BY ALL"),
    "repeated_medians": (repeated_medians, _E + " SELECT CAST(k AS INTEGER) AS epoch_index, label, CAST(idx AS INTEGER) AS idx, round(median(x * (k + 1)), 6) + 0.0 AS x FROM e, unnest(range(3)) u(k) GROUP BY ALL"),
    "vector_checks": (
        vector_checks,
        _E + ", v AS (SELECT vec_id, label, bool_or(NOT isfinite(x)) AS bad, bool_and(x = 0) AS z, bool_and(x < 0) AS neg, bool_or(x = 0) AS az, bool_or(x < 0) AS an, bool_or(x > 0.3) AS o FROM e GROUP BY 1, 2) SELECT label, NOT bool_or(bad OR z OR neg) AS valid, NOT bool_or(bad OR z OR neg OR az OR an) AS strict, count(*) FILTER (o) AS n_over FROM v GROUP BY 1",
    ),
    "epoch_means": (epoch_means, _FOLDED + ", s AS (SELECT fold_name, epoch_index, subject_name, used_labels, avg(dice) AS dice FROM rows GROUP BY ALL) SELECT fold_name, epoch_index, used_labels, round(avg(dice), 6) AS dice FROM s GROUP BY ALL"),
    "best_epoch_means": (best_epoch_means, _FOLDED + ", s AS (SELECT fold_name, subject_name, used_labels, avg(dice) AS dice FROM rows WHERE epoch_index = best GROUP BY ALL) SELECT fold_name, used_labels, round(avg(dice), 6) AS dice FROM s GROUP BY ALL"),
    "size_table": (size_table, _FOLDED + ", s AS (SELECT epoch_index + 1 AS size, CASE WHEN fold_name = 'A' THEN 1 ELSE 0 END AS seed, subject_name, used_labels, avg(dice) AS dice FROM rows GROUP BY ALL) SELECT CAST(size AS INTEGER) AS size, seed, used_labels, round(avg(dice), 6) AS dice FROM s GROUP BY ALL"),
    "mean_of_means": (mean_of_means, "WITH i AS (SELECT c_nationkey, o_custkey, o_orderkey, avg(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL), s AS (SELECT c_nationkey, o_custkey, avg(q) AS q FROM i GROUP BY ALL) SELECT c_nationkey, round(avg(q), 6) AS mean FROM s GROUP BY 1"),
    "tolerance_over_subjects": (tolerance_over_subjects, "WITH s AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.75) AS q FROM lineitem GROUP BY 1) SELECT round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std FROM s"),
    "matrix_permuted": (matrix_permuted, "SELECT CAST(5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS i, CAST(4 - o_custkey % 5 AS INTEGER) AS j, count(*) AS n FROM orders GROUP BY ALL"),
    "split_images": (split_images, "SELECT o_orderkey, o_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'test' ELSE 'train' END AS split_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "validated_update": (validated_update, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'new' ELSE o_orderpriority END AS o_orderpriority FROM orders"),
    "enough_rows": (enough_rows, "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity >= 10) > 3 AND count(DISTINCT l_linestatus) FILTER (l_linestatus IN ('F', 'O')) = 2"),
    "perfusion_states": (perfusion_states, "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 AND l_discount > 0.05 THEN NULL WHEN l_returnflag = 'A' THEN 'physiological' WHEN l_returnflag = 'R' THEN 'ischemic' END AS perfusion_state FROM lineitem"),
    "in_situ_images": (in_situ_images, "SELECT o_orderkey, o_orderstatus = 'P' OR o_totalprice > 50000 AND o_orderpriority <> '5-LOW' AS in_situ FROM orders"),
    "challenge_rows": (challenge_rows, "SELECT c_custkey, 'balance' AS task, CAST(c_acctbal AS DOUBLE) AS \"value\" FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_nationkey > 3"),
    "confidence_rows": (confidence_rows, "SELECT l_orderkey, t AS threshold, l_returnflag || l_linenumber AS label, round(l_discount * k, 6) AS area, round(l_tax * k, 6) AS dice FROM lineitem, (VALUES (0.5::DOUBLE, 1.0::DOUBLE), (0.75, 0.5)) v(t, k)"),
    "eliminated_features": (eliminated_features, "WITH m AS (SELECT p_type, avg(p_size) AS m FROM part GROUP BY 1) SELECT p_type, CAST(row_number() OVER w AS INTEGER) AS place, row_number() OVER w = 1 AS \"first\" FROM m WINDOW w AS (ORDER BY m, p_type)"),
    "rate_at_share": (rate_at_share, _ROC21),
    "annotator_distances": (annotator_distances, _BORDERS),
}
