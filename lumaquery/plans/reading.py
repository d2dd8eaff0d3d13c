"""Label mappings, table reading, joins and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.labels import LabelMapping, by_given_order, domain_index, order_key, remap
from ..operators import checks as C
from ..operators import joins as J
from ..session import dealt, tables
from ..sources.tables import basic_statistics, median_table, union_tables
from .corpus import STATS, stats

MAPPING = LabelMapping({"PROMO": 0, "SMALL": 1, "LARGE": 0, "MEDIUM": 2, "ECONOMY": 3}, last_valid=2)
_MAP = "(VALUES ('PROMO', 0), ('SMALL', 1), ('LARGE', 0), ('MEDIUM', 2), ('ECONOMY', 3)) m(name, idx)"
_ORDER = ["STANDARD", "MEDIUM", "PROMO"]


def _t(spark, sf_dir, *names):
    return tables(spark, sf_dir, *names)


def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")["lineitem"]
    code = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return li.select(remap(code, {1: 10, 3: 30}).alias("mapped")).groupBy("mapped").agg(F.count("*").alias("n"))


def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to indices and back; the first name of an index wins."""
    names = _t(spark, sf_dir, "part")["part"].select(F.col("p_type").alias("label_name"))
    index = LabelMapping(MAPPING.names, 2, unknown="invalid").index(F.col("label_name"))
    return names.groupBy("label_name", index.alias("label_index"), MAPPING.name(index).alias("back"), MAPPING.is_valid(index).cast("int").alias("valid")).agg(F.count("*").alias("n"))


def custom_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    names = _t(spark, sf_dir, "part")["part"].select(F.col("p_type").alias("label_name")).distinct()
    return names.select("label_name", F.row_number().over(Window.orderBy(*order_key("label_name", _ORDER))).alias("position"))


def given_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "region")["region"]
    return by_given_order(rows, "r_name", ["ASIA", "AFRICA", "ASIA", "EUROPE"]).select("r_name", "r_regionkey")


def domain_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "customer", "nation")
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("n_name")).alias("domain"))
    return domain_index(rows, "domain").groupBy("domain", "domain_index").agg(F.count("*").alias("n"))


def _median(spark, sf_dir) -> DataFrame:
    """Annotation tables of two datasets and two annotations."""
    s = stats(spark, sf_dir).withColumnRenamed("n_pixels", "n")
    return s.select(
        F.when(F.col("is_test"), "masks#a").otherwise("semantic").alias("dataset_name"),
        F.lit("").alias("table_name"),
        F.when(F.col("n") % 2 == 0, "polygon").otherwise("semantic").alias("annotation_name"),
        F.col("image_name").cast("string").alias("image_name"), "subject_name", "timestamp", "label_name",
        F.length("label_name").alias("label_index"), F.col("n").alias("n_pixels"),
    )


_MEDIAN = STATS + """, med AS (
    SELECT CASE WHEN is_test THEN 'masks#a' ELSE 'semantic' END AS dataset_name, CASE WHEN n_pixels % 2 = 0 THEN 'polygon' ELSE 'semantic' END AS annotation_name,
           CAST(image_name AS VARCHAR) AS image_name, subject_name, label_name, length(label_name) AS label_index, n_pixels FROM df
)"""


def median_table_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sub-datasets of a name, one annotation, mapped labels."""
    out = median_table(_median(spark, sf_dir), dataset_name="masks", annotation_name="polygon", label_mapping=MAPPING)
    return out.select("image_name", "label_name", F.col("label_index").cast("int").alias("label_index"), "n_pixels")


def median_table_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*map(str, range(1, 400)), "401@polygon", "402@polygon&semantic", "7"]
    out = median_table(_median(spark, sf_dir), image_names=names, priority=["semantic"])
    return out.select("dataset_name", "annotation_name", "image_name", "label_name", "n_pixels")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = stats(spark, sf_dir).where("is_test").select(F.col("image_name").cast("string").alias("image_name"), F.lit("test").alias("split_name"))
    n = _t(spark, sf_dir, "lineitem")["lineitem"].count()
    out = basic_statistics(dealt(_median(spark, sf_dir), n, "image_name"), dealt(spec, n, "image_name"), MAPPING)
    return out.groupBy("set_type", "label_index", F.col("label_valid").cast("int").alias("label_valid")).agg(F.sum("n_pixels").alias("n_pixels"), F.count("*").alias("n"))


def first_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    t = _t(spark, sf_dir, "orders", "lineitem")
    rows = union_tables({"a": t["orders"].where("o_orderstatus = 'F'").select("o_orderkey"), "b": t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey")).distinct()})
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("o_orderkey").orderBy("source"))).where("_r = 1").select("o_orderkey", "source")


def meta_natural_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders", "customer")
    left = t["orders"].select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("custkey"))
    unknown = spark.createDataFrame([(None, "unknown")], "custkey long, c_name string")
    right = t["customer"].where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"), "c_name").unionAll(unknown)
    return J.natural_left(left, right)


def coalesce_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders", "lineitem")
    old = t["orders"].select("o_orderkey", F.col("o_totalprice").alias("price"))
    new = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.count("*") > 2, F.max("l_extendedprice")).alias("price"))
    return C.update_validation(old, new, ["o_orderkey"])


def fallback_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "lineitem", "part")
    rows = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("subject"), F.col("p_type").alias("label"), "l_quantity", "l_returnflag")
    base = rows.where("l_returnflag = 'R' and l_quantity > 40")
    exact = base.groupBy("subject", "label").agg(F.avg("l_quantity").alias("baseline"))
    general = base.groupBy("label").agg(F.avg("l_quantity").alias("baseline"))
    out = J.fallback(rows.select("subject", "label").distinct(), exact, general, ["subject", "label"], ["label"], "baseline")
    return out.select("subject", "label", F.round("baseline", 6).alias("baseline"))


def anti_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders", "lineitem")
    return t["orders"].join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


def semi_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders", "customer")
    return t["customer"].join(t["orders"].where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "customer", "supplier")
    return union_tables({"customer": t["customer"].select(F.col("c_name").alias("name"), "c_mktsegment"), "supplier": t["supplier"].select(F.col("s_name").alias("name"), "s_nationkey")})


def set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders", "lineitem")
    key = lambda d, c: d.select(F.col(c).alias("k"))
    o, i = key(t["orders"], "o_orderkey"), key(t["lineitem"], "l_orderkey")
    both = key(t["orders"].where("o_orderstatus = 'P'"), "o_orderkey").intersect(key(t["lineitem"].where("l_returnflag = 'R'"), "l_orderkey"))
    return o.exceptAll(i.distinct()).select("k", F.lit("only orders").alias("side")).unionAll(both.select("k", F.lit("both")))


def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders", "lineitem")
    li = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    found = C.repeated_keys(li, ["o_orderkey", "l_linenumber"]).unionAll(C.missing_keys(t["orders"], li, ["o_orderkey"]))
    found = found.unionAll(C.shared_keys({"a": t["orders"].where("o_orderstatus = 'F'"), "b": t["orders"].where("o_totalprice > 200000")}, ["o_orderkey"]))
    shared = C.shared_keys({"a": t["orders"], "b": t["orders"].where("o_orderstatus = 'P'")}, ["o_orderkey"], "shared")
    return found.unionAll(shared).unionAll(C.unequal_counts(li, ["l_linenumber"])).groupBy("check").agg(F.count("*").alias("n"))


def version_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders", "customer")
    changes = t["customer"].where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.lit("1996-01-01").cast("timestamp").alias("_at"), F.lit("v1").alias("_b"), F.lit("v2").alias("_a"))
    out = J.version(t["orders"].select("o_orderkey", "o_custkey", "o_orderdate"), changes.withColumn("_b", F.lit("v1")), "o_orderdate", "o_custkey", "_at", "_b", "_a", "version")
    return out.select("o_orderkey", "version")


def neighbour_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")["lineitem"]
    lines = li.select(F.col("l_suppkey").alias("image"), F.pmod("l_orderkey", F.lit(25)).cast("int").alias("row"), F.pmod("l_partkey", F.lit(25)).cast("int").alias("col"), "l_linenumber")
    # an image has 625 cells at most, so it stays in one task, and what follows needs no other exchange; a cell has up to eight moved copies
    cells = dealt(lines, 4 * li.count(), "image").groupBy("image", "row", "col").agg(F.min("l_linenumber").alias("label"))
    return J.neighbours(cells, ["image"])


def key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")["orders"]
    time = F.date_format("o_orderdate", K.TIMESTAMP)
    key = K.with_annotations(K.join_key(F.col("o_custkey").cast("string"), time), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")))
    parts = o.select("o_orderkey", K.split_key(key).alias("k"))
    return parts.select("o_orderkey", "k.subject", K.timestamp(F.col("k.time")).alias("time"), F.array_join("k.annotations", ",").alias("annotations"))


def pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer")["customer"].select("c_custkey", K.pseudonym(F.col("c_name"), "salt").alias("hashed"))


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")["events"]
    return e.select(K.json_at(F.col("props"), "k", "none").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def filled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First filled attribute, any filled, substring and prefix tests."""
    p = _t(spark, sf_dir, "part")["part"].select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_type")).alias("a"), F.when(F.col("p_size") < 10, F.col("p_brand")).alias("b"), "p_name")
    return p.select("p_partkey", K.first_filled(["a", "b"]).alias("label"), K.any_filled("a", "b").cast("int").alias("any"), K.holds("a", "AL").cast("int").alias("holds"), F.col("p_name").startswith("p").cast("int").alias("prefix"))


def melt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")["lineitem"]
    return li.select("l_orderkey", "l_linenumber", "l_discount", "l_tax").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "metric", "value")


def implode_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import implode

    li = _t(spark, sf_dir, "lineitem")["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    out = implode(li, ["l_orderkey"], "l_linenumber", ["q"])
    return out.select("l_orderkey", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


def label_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import presence

    rows = stats(spark, sf_dir).select("subject_name", "label_name")
    return presence(rows, "subject_name", "label_name", ["PROMO", "SMALL"])


QUERIES = {
    "label_remap": (label_remap, "SELECT CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 2 ELSE 30 END AS mapped, count(*) AS n FROM lineitem GROUP BY 1"),
    "label_names": (label_names, f"SELECT p_type AS label_name, coalesce(idx, 3) AS label_index, CASE coalesce(idx, 3) WHEN 0 THEN 'PROMO' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' ELSE 'ECONOMY' END AS back, CAST(coalesce(idx, 3) <= 2 AS INTEGER) AS valid, count(*) AS n FROM part LEFT JOIN {_MAP} ON p_type = name GROUP BY ALL"),
    "custom_sort_rank": (custom_sort_rank, "SELECT p_type AS label_name, CAST(row_number() OVER (ORDER BY CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'PROMO' THEN 2 ELSE 9 END, p_type) AS INTEGER) AS position FROM (SELECT DISTINCT p_type FROM part)"),
    "given_order": (given_order, "SELECT r_name, r_regionkey FROM region WHERE r_name IN ('ASIA', 'AFRICA', 'EUROPE')"),
    "domain_indices": (domain_indices, "WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN n_name END AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey), d AS (SELECT domain, CAST(dense_rank() OVER (ORDER BY domain) - 1 AS INTEGER) AS domain_index FROM (SELECT DISTINCT domain FROM r WHERE domain IS NOT NULL)) SELECT r.domain, coalesce(domain_index, 0) AS domain_index, count(*) AS n FROM r LEFT JOIN d ON r.domain = d.domain GROUP BY ALL"),
    "median_table_dataset": (median_table_dataset, _MEDIAN + f" SELECT image_name, label_name, idx AS label_index, n_pixels FROM med JOIN {_MAP} ON label_name = name AND idx <= 2 WHERE dataset_name LIKE 'masks#%' AND annotation_name = 'polygon'"),
    "median_table_images": (median_table_images, _MEDIAN + " SELECT dataset_name, annotation_name, image_name, label_name, n_pixels FROM med WHERE CAST(image_name AS BIGINT) BETWEEN 1 AND 399 OR (image_name = '401' AND annotation_name = 'polygon') OR image_name = '402'"),
    "basic_statistics": (statistics, _MEDIAN + f" SELECT CASE WHEN dataset_name = 'masks#a' THEN 'test' END AS set_type, idx AS label_index, CAST(coalesce(idx <= 2, false) AS INTEGER) AS label_valid, CAST(sum(n_pixels) AS BIGINT) AS n_pixels, count(*) AS n FROM med LEFT JOIN {_MAP} ON label_name = name GROUP BY ALL"),
    "first_source_wins": (first_source_wins, "SELECT o_orderkey, min(source) AS source FROM (SELECT o_orderkey, 'a' AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, 'b' FROM lineitem) GROUP BY 1"),
    "meta_natural_left": (meta_natural_left, "WITH l AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS custkey FROM orders), r AS (SELECT c_custkey AS custkey, c_name FROM customer WHERE c_acctbal > 0 UNION ALL SELECT NULL, 'unknown') SELECT o_orderkey, l.custkey, c_name FROM l LEFT JOIN r ON l.custkey IS NOT DISTINCT FROM r.custkey"),
    "coalesce_update": (coalesce_update, "SELECT o_orderkey, coalesce(p, o_totalprice) AS price FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN count(*) > 2 THEN max(l_extendedprice) END AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"),
    "fallback_baseline": (fallback_baseline, "WITH r AS (SELECT l_suppkey AS subject, p_type AS label, l_quantity AS q, l_returnflag AS f FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT * FROM r WHERE f = 'R' AND q > 40), e AS (SELECT subject, label, avg(q) AS v FROM b GROUP BY ALL), g AS (SELECT label, avg(q) AS v FROM b GROUP BY ALL) SELECT d.subject, d.label, round(coalesce(e.v, g.v), 6) AS baseline FROM (SELECT DISTINCT subject, label FROM r) d LEFT JOIN e USING (subject, label) LEFT JOIN g ON g.label = d.label"),
    "anti_overlap": (anti_overlap, "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "semi_members": (semi_members, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "union_by_name": (union_by_name, "SELECT c_name AS name, c_mktsegment, NULL::INTEGER AS s_nationkey, 'customer' AS source FROM customer UNION ALL SELECT s_name, NULL, s_nationkey, 'supplier' FROM supplier"),
    "set_checks": (set_checks, "SELECT o_orderkey AS k, 'only orders' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT o_orderkey, 'both' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "quality_violations": (
        quality_violations,
        "WITH n AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1), u AS (SELECT n FROM n GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1), v AS (SELECT 'repeated key' AS c FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'missing key' FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) UNION ALL SELECT 'key in several parts' FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000) UNION ALL SELECT 'shared' FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'unequal counts' FROM n WHERE n <> (SELECT n FROM u)) SELECT c AS \"check\", count(*) AS n FROM v GROUP BY 1",
    ),
    "version_lookup": (version_lookup, "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) THEN CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'v1' ELSE 'v2' END END AS version FROM orders"),
    "neighbour_matrix": (neighbour_matrix, "WITH c AS (SELECT l_suppkey AS image, CAST(l_orderkey % 25 AS INTEGER) AS r, CAST(l_partkey % 25 AS INTEGER) AS k, min(l_linenumber) AS label FROM lineitem GROUP BY ALL), p AS (SELECT DISTINCT a.image, a.label AS \"of\", b.r, b.k, b.label FROM c a JOIN c b ON a.image = b.image AND abs(a.r - b.r) <= 1 AND abs(a.k - b.k) <= 1 AND a.label <> b.label) SELECT image, \"of\", label, count(*) AS n FROM p GROUP BY ALL"),
    "key_parse": (key_parse, "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS subject, date_trunc('second', o_orderdate) AS time, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE '' END AS annotations FROM orders"),
    "pseudonym": (pseudonym, "SELECT c_custkey, sha256(c_name || 'salt') AS hashed FROM customer"),
    "json_flatten": (json_flatten, "SELECT coalesce(json_extract_string(props, '$.k'), 'none') AS k, count(*) AS n FROM events GROUP BY 1"),
    "filled_columns": (filled_columns, "WITH p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type END AS a, CASE WHEN p_size < 10 THEN p_brand END AS b, p_name FROM part) SELECT p_partkey, coalesce(a, b) AS label, CAST(coalesce(a, b) IS NOT NULL AS INTEGER) AS \"any\", CAST(coalesce(contains(a, 'AL'), false) AS INTEGER) AS holds, CAST(starts_with(p_name, 'p') AS INTEGER) AS prefix FROM p"),
    "melt_metrics": (melt_metrics, "SELECT l_orderkey, l_linenumber, 'l_discount' AS metric, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem"),
    "implode_min": (implode_min, "SELECT l_orderkey, string_agg(CAST(q AS VARCHAR), ',' ORDER BY l_linenumber) AS q FROM (SELECT l_orderkey, l_linenumber, CAST(min(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY ALL) GROUP BY 1"),
    "label_presence": (label_presence, STATS + " SELECT subject_name, max(CAST(label_name = 'PROMO' AS INTEGER)) AS \"PROMO\", max(CAST(label_name = 'SMALL' AS INTEGER)) AS \"SMALL\" FROM df GROUP BY 1"),
}
