"""Cohorts and their checks, and filled cells, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..operators import cells as R
from ..operators import cohorts as H
from ..session import tables


def tagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority text holds a tag, with a known state."""
    o = tables(spark, sf_dir, "orders")["orders"].withColumn("state", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return H.tagged(o, "o_orderpriority", "-HIGH", ["state"]).select("o_orderkey", "state")


def complete_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three kinds of parts from suppliers that have all of the three."""
    t = tables(spark, sf_dir, "lineitem", "part")
    rows = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).withColumn("camera", F.concat_ws("-", "l_suppkey", F.pmod("l_orderkey", F.lit(97))))
    out = H.complete_groups(rows, "camera", "p_type", ["PROMO", "SMALL", "LARGE"])
    return out.select("l_orderkey", "l_linenumber", "camera")


def clear_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by a rule of their phase, as species have rules of their own."""
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    rules = {"A": (F.col("l_quantity") > 25) | (F.col("l_discount") < 0.03), "R": F.lit(True), "N": F.col("l_linestatus") != "F"}
    return H.by_part(li, "l_returnflag", rules).select("l_orderkey", "l_linenumber", "l_returnflag")


def dosed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the days since each of their urgent orders as a series of doses."""
    t = tables(spark, sf_dir, "orders", "customer")
    days = F.datediff(F.lit("1998-08-03").cast("date"), F.col("o_orderdate").cast("date")).cast("double")
    doses = t["orders"].where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.collect_list(days).alias("doses"))
    rows = t["customer"].select("c_custkey").join(doses, F.col("c_custkey") == F.col("o_custkey"), "left")
    return H.dosed(rows, "doses", 600).select("c_custkey", "last_injection", "series", "clear", "perfusion_state")


def apart_from_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders of customers who have no order of low priority."""
    o = tables(spark, sf_dir, "orders")["orders"]
    return H.without_subjects(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"), "o_custkey").select("o_orderkey", "o_custkey")


def paper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen orders and lines as one table with their cohort."""
    t = tables(spark, sf_dir, "orders", "lineitem")
    orders = t["orders"].select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    lines = t["lineitem"].select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("value"), "l_returnflag")
    out = H.paper({"malperfused": (orders, (F.col("o_orderstatus") == "F") | (F.col("value") > 300000)), "icg": (lines, F.col("l_returnflag") == "R")}, "standardised", {"icg"})
    return out.select("cohort", "key", "value", "standardised")


def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are in several splits of a fold, and splits that a fold lacks."""
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    spec = li.select(F.pmod("l_suppkey", F.lit(4)).alias("fold_name"), F.col("l_partkey").alias("image_name"), F.when(F.col("l_linestatus") == "O", "train").when(F.col("l_returnflag") == "R", "val").otherwise("test").alias("split_name"))
    found = H.shared_between_splits(spec, "image_name", may=("test",)).unionAll(H.empty_splits(spec, ["train", "val", "val_known"]))
    return found


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of four entries as cells of ten images."""
    e = tables(spark, sf_dir, "embeddings")["embeddings"]
    return e.select(F.col("label").alias("image"), F.col("vec_id").alias("row"), F.pmod("vec_id", F.lit(7)).alias("col"), F.pmod("vec_id", F.lit(3)).cast("int").alias("label"), F.slice(V.doubles("embedding"), 1, 4).alias("value"))


def _filled(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _cells(spark, sf_dir)
        donor = c.where("row % 5 = 0").select("row", "col", F.transform("value", lambda x: x + 1).alias("value"))
        out = R.fill_vectors(c, "image", F.col("label") == 1, how, p=0.7, seed=3, donor=donor)
        return out.select("image", "row", "col", "label", F.posexplode("value").alias("k", "x")).select("image", "row", "col", "label", "k", F.round("x", 6).alias("x"))

    return run


def _u(parts: str) -> str:
    """The oracle's spelling of ``bootstrap.uniform``."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 13) AS BIGINT) / 4503599627370496.0)"


_C = f"WITH c AS (SELECT label AS image, vec_id AS \"row\", vec_id % 7 AS col, vec_id % 3 AS l, k, CAST(embedding[k + 1] AS DOUBLE) AS x, vec_id % 3 = 1 AND {_u('3, label')} < 0.7 AS hit FROM embeddings, unnest(range(4)) u(k))"
_OUT = "SELECT image, \"row\", col, CAST(CASE WHEN hit THEN 100 ELSE l END AS INTEGER) AS label, CAST(k AS INTEGER) AS k, round(CASE WHEN hit THEN {} ELSE x END, 6) + 0.0 AS x FROM c"

QUERIES = {
    "tagged_rows": (tagged_rows, "SELECT o_orderkey, o_orderstatus AS state FROM orders WHERE contains(o_orderpriority, '-HIGH') AND o_orderstatus <> 'P'"),
    "complete_cameras": (complete_cameras, "WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey || '-' || l_orderkey % 97 AS camera, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'SMALL', 'LARGE')) SELECT l_orderkey, l_linenumber, camera FROM r WHERE camera IN (SELECT camera FROM r GROUP BY 1 HAVING count(DISTINCT p_type) = 3)"),
    "clear_cases": (clear_cases, "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE CASE l_returnflag WHEN 'A' THEN l_quantity > 25 OR l_discount < 0.03 WHEN 'R' THEN true WHEN 'N' THEN l_linestatus <> 'F' ELSE false END"),
    "dosed_series": (dosed_series, "WITH d AS (SELECT o_custkey, min(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-03')) AS m, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT c_custkey, CAST(m AS DOUBLE) AS last_injection, CAST(n AS INTEGER) AS series, coalesce(m <= 600, false) AS clear, CASE WHEN n IS NULL THEN 'physiological' ELSE 'icg' END AS perfusion_state FROM customer LEFT JOIN d ON c_custkey = o_custkey"),
    "apart_from_training": (apart_from_training, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')"),
    "paper_rows": (paper_rows, "SELECT 'malperfused' AS cohort, o_orderkey AS \"key\", o_totalprice AS \"value\", false AS standardised FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 300000 UNION ALL SELECT 'icg', l_orderkey, l_extendedprice, true FROM lineitem WHERE l_returnflag = 'R'"),
    "split_violations": (
        split_violations,
        "WITH s AS (SELECT DISTINCT l_suppkey % 4 AS f, l_partkey AS p, CASE WHEN l_linestatus = 'O' THEN 'train' WHEN l_returnflag = 'R' THEN 'val' ELSE 'test' END AS s FROM lineitem) SELECT 'image_name in several splits' AS \"check\", f || '#' || p AS \"key\" FROM s WHERE s <> 'test' GROUP BY f, p HAVING count(*) > 1 UNION ALL SELECT 'empty split', f || '#' || w FROM (SELECT DISTINCT f FROM s) x, (VALUES ('train'), ('val'), ('val_known')) v(w) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.f = x.f AND s.s = w)",
    ),
    "filled_zero": (_filled("zero"), _C + " " + _OUT.format("0")),
    "filled_random": (_filled("random"), _C + f", d AS (SELECT *, {_u('4, image, \"row\", col, k')} AS u FROM c), e AS (SELECT *, u / sum(u) OVER (PARTITION BY \"row\") AS v FROM d) " + _OUT.format("v").replace("FROM c", "FROM e")),
    "filled_donor": (_filled("donor"), _C + " " + _OUT.format("CASE WHEN \"row\" % 5 = 0 THEN x + 1 ELSE 0 END")),
}
