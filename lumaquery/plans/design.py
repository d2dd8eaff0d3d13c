"""Fold design, dependence of columns, nested documents and sample streams as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions import documents as N
from ..operators import cells as R
from ..operators import curves as U
from ..operators import dependence as P
from ..operators import extensions as E
from ..operators import folds as G
from ..session import tables
from ..streaming import samples as S

K = 5
STATUS = ["F", "O", "P"]


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in five folds with even shares of order states."""
    o = tables(spark, sf_dir, "orders")["orders"].select("o_custkey", "o_orderstatus")
    return G.group_folds(o, "o_custkey", "o_orderstatus", K)


def _group_folds_sql() -> str:
    """The greedy order replayed by recursion, a customer a step; counts are lists of labels within folds."""
    n = len(STATUS)
    x = ", ".join(f"count(*) FILTER (o_orderstatus = '{s}')" for s in STATUS)
    w = ", ".join(f"1000000000000000000::HUGEINT // greatest(1, sum(x[{j + 1}])::HUGEINT * sum(x[{j + 1}])::HUGEINT)" for j in range(n))
    spread = " + ".join(f"x[{j + 1}]::HUGEINT * x[{j + 1}] * w[{j + 1}]" for j in range(n))
    cost = lambda f: " + ".join(f"h[{f * n + j + 1}]::HUGEINT * i.x[{j + 1}] * i.w[{j + 1}]" for j in range(n))
    rows = lambda f: " + ".join(f"h[{f * n + j + 1}]" for j in range(n))
    # cost, then rows, then the number of the fold, as one sortable list
    ways = ", ".join(f"[{cost(f)}, ({rows(f)})::HUGEINT, {f}::HUGEINT]" for f in range(K))
    new = ", ".join(f"h[{f * n + j + 1}] + CASE WHEN fold = {f} THEN x[{j + 1}] ELSE 0 END" for f in range(K) for j in range(n))
    return f"""
WITH RECURSIVE c AS (SELECT o_custkey, [{x}] AS x FROM orders GROUP BY 1),
w AS (SELECT [{w}] AS w FROM c),
i AS MATERIALIZED (SELECT o_custkey, x, w, row_number() OVER (ORDER BY {spread} DESC, CAST(o_custkey AS VARCHAR)) AS k FROM c, w),
r AS (
    SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS o_custkey, CAST(NULL AS INTEGER) AS fold, [{', '.join(['0::BIGINT'] * (n * K))}] AS h
    UNION ALL
    SELECT k, o_custkey, fold, [{new}] FROM (
        SELECT i.k, i.o_custkey, i.x, h, CAST(list_sort([{ways}])[1][3] AS INTEGER) AS fold FROM r JOIN i ON i.k = r.k + 1
    ) s
)
SELECT o_custkey, fold FROM r WHERE k > 0"""


def nested_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' customers in nested greedy folds by market segment."""
    c = tables(spark, sf_dir, "customer")["customer"].select("c_nationkey", "c_mktsegment")
    return G.nested_group_folds(c, "c_nationkey", "c_mktsegment", 3, 2)


def fold_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways to put the kinds of parts into groups of three, by the sizes that each kind has."""
    part = tables(spark, sf_dir, "part")["part"].groupBy("p_type").agg(F.collect_set("p_size").alias("sizes"))
    out = G.fold_partitions(part, "p_type", "sizes", 3)
    return out.select(F.array_join(F.transform("groups", lambda g: F.array_join(g, ",")), ";").alias("groups"), "n_labels")


FOLD_PARTITIONS = """
WITH RECURSIVE l AS (SELECT p_type AS s, list(DISTINCT p_size) AS l FROM part GROUP BY 1),
t AS MATERIALIZED (SELECT s, l, row_number() OVER (ORDER BY s) - 1 AS p, count(*) OVER () AS n FROM l),
g AS MATERIALIZED (
    SELECT a.p AS a, b.p AS b, c.p AS c, a.s || ',' || b.s || ',' || c.s AS name, len(list_distinct(list_concat(a.l, list_concat(b.l, c.l)))) AS k, a.n
    FROM t a JOIN t b ON b.p > a.p JOIN t c ON c.p > b.p
), w AS (
    SELECT CAST([] AS BIGINT[]) AS used, '' AS groups, 0::BIGINT AS n_labels, 0 AS step
    UNION ALL
    SELECT list_concat(used, [g.a, g.b, g.c]), CASE WHEN step = 0 THEN g.name ELSE groups || ';' || g.name END, n_labels + g.k, step + 1
    FROM w JOIN g ON NOT list_contains(w.used, g.a) AND len(list_filter(w.used, lambda x: x < g.a)) = g.a AND NOT list_contains(w.used, g.b) AND NOT list_contains(w.used, g.c)
)
SELECT groups, CAST(n_labels AS INTEGER) AS n_labels FROM w WHERE step * 3 = (SELECT max(n) FROM t)
"""


def vector_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance correlation of the vectors' first and second halves within each label."""
    e = tables(spark, sf_dir, "embeddings")["embeddings"].select("label", "vec_id", V.doubles("embedding").alias("v"))
    rows = e.select("label", "vec_id", F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("y"))
    return P.distance_correlation(rows, ["label"], "vec_id", "x", "y").select("label", F.round("dcor", 6).alias("dcor"))


VECTOR_DEPENDENCE = """
WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS v FROM embeddings),
p AS (
    SELECT a.label, a.vec_id AS i, b.vec_id AS j,
           sqrt(list_sum(list_transform(list_zip(a.v[1:32], b.v[1:32]), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS a,
           sqrt(list_sum(list_transform(list_zip(a.v[33:64], b.v[33:64]), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS b
    FROM v a JOIN v b USING (label)
), c AS (
    SELECT label, a - avg(a) OVER (PARTITION BY label, i) - avg(a) OVER (PARTITION BY label, j) + avg(a) OVER (PARTITION BY label) AS a,
           b - avg(b) OVER (PARTITION BY label, i) - avg(b) OVER (PARTITION BY label, j) + avg(b) OVER (PARTITION BY label) AS b FROM p
)
SELECT label, round(sqrt(greatest(avg(a * b), 0)) / sqrt(sqrt(avg(a * a) * avg(b * b))), 6) AS dcor FROM c GROUP BY label
"""


def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document of every customer under one of its nation."""
    t = tables(spark, sf_dir, "customer", "nation")
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    nation = F.to_json(F.struct(F.struct(F.lit("nation").alias("level"), F.struct(F.col("n_name").alias("nation"), F.lit(0).alias("segment")).alias("names")).alias("about"), F.col("n_regionkey").alias("region")))
    own = F.to_json(F.struct(F.struct(F.struct(F.col("c_mktsegment").alias("segment")).alias("names")).alias("about"), F.array("c_nationkey").alias("keys")))
    return rows.select("c_custkey", N.merged_text(nation, own, 4).alias("document"))


MERGED = """
SELECT c_custkey, '{"about":{"level":"nation","names":{"nation":"' || n_name || '","segment":"' || c_mktsegment || '"}},"keys":[' || c_nationkey || '],"region":' || n_regionkey || '}' AS document
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def camera_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' metadata as one table of differing keys, with the version that was valid on the day."""
    o = tables(spark, sf_dir, "orders")["orders"].select(F.col("o_orderkey").alias("image_name"), F.date_format("o_orderdate", "yyyy_MM_dd").alias("day"), "o_orderstatus", "o_orderpriority")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in (("Camera_CamID", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))), ("day", F.col("day")), ("mode", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority"))))])
    entries = o.select("image_name", F.explode(pairs).alias("e")).select("image_name", "e.*").where("value is not null")
    changes = spark.sql("SELECT * FROM VALUES ('F', '1995_06_01', 'wrong-1', 'correct-2'), ('O', '1997_01_01', 'correct-1', 'correct-2') AS c(camera, change_date, suffix_before, suffix_after)")
    table = N.metadata_table(entries, "image_name")
    return N.camera_names(table, changes, "day").select("image_name", "day", "mode", "Camera_CamID", "camera_name")


CAMERA_VERSIONS = """
SELECT o_orderkey AS image_name, strftime(o_orderdate, '%Y_%m_%d') AS "day", CASE WHEN starts_with(o_orderpriority, '1') THEN o_orderpriority END AS "mode",
       CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'unknown' END AS "Camera_CamID",
       CASE o_orderstatus WHEN 'F' THEN CASE WHEN strftime(o_orderdate, '%Y_%m_%d') < '1995_06_01' THEN 'F_wrong-1' ELSE 'F_correct-2' END
                          WHEN 'O' THEN CASE WHEN strftime(o_orderdate, '%Y_%m_%d') < '1997_01_01' THEN 'O_correct-1' ELSE 'O_correct-2' END ELSE 'unknown_correct-1' END AS camera_name
FROM orders
"""


def colour_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightness of colours made of line items, and which are highlights."""
    t = tables(spark, sf_dir, "lineitem")["lineitem"]
    rgb = [(F.col("l_partkey") % 256).cast("int"), (F.col("l_suppkey") * 7 % 256).cast("int"), (F.col("l_orderkey") % 256).cast("int")]
    return t.select("l_orderkey", "l_linenumber", F.round(R.lightness(*rgb), 6).alias("lightness"), R.specular(*rgb, 70.0).alias("highlight"))


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"


HIGHLIGHTS = f"""
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 256 AS DOUBLE) AS r, CAST(l_suppkey * 7 % 256 AS DOUBLE) AS g, CAST(l_orderkey % 256 AS DOUBLE) AS b FROM lineitem),
y AS (SELECT l_orderkey, l_linenumber, 0.212671 * ({_linear('r')}) + 0.71516 * ({_linear('g')}) + 0.072169 * ({_linear('b')}) AS y FROM c),
l AS (SELECT l_orderkey, l_linenumber, 116 * (CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 4.0 / 29 END) - 16 AS l FROM y)
SELECT l_orderkey, l_linenumber, round(l, 6) AS lightness, l > 70 AS highlight FROM l
"""


def _u(parts: str) -> str:
    """The oracle's spelling of ``bootstrap.uniform``."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 13) AS BIGINT) / 4503599627370496.0)"


def stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs and a bit of the endless stream over suppliers, its numbers taken from the orders."""
    t = tables(spark, sf_dir, "supplier", "orders")
    numbers = t["orders"].select((F.col("o_orderkey") - 1).alias("n")).where("n >= 0").distinct()
    out = S.drawn(numbers, "n", t["supplier"].select("s_suppkey"), "s_suppkey", 32, workers=4)
    return out.select("epoch", "batch", "slot", "worker", "s_suppkey")


STREAM_ORDER = f"""
WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY {_u('0, s_suppkey')}, s_suppkey) - 1 AS k, count(*) OVER () AS c FROM supplier),
o AS (SELECT DISTINCT o_orderkey - 1 AS n FROM orders WHERE o_orderkey >= 1),
e AS (SELECT n, c, n // c AS epoch FROM o, (SELECT any_value(c) AS c FROM s) x),
p AS (SELECT n, epoch, c, ((n % c) * ({S.steps(1)})[CAST(floor({_u("0, 'step', epoch")} * {S.STEPS}) AS BIGINT) + 1] + CAST(floor({_u("0, 'start', epoch")} * c) AS BIGINT)) % c AS k FROM e)
SELECT epoch, n // 32 AS batch, CAST(n % 32 AS INTEGER) AS slot, CAST(n % 32 * 4 // 32 AS INTEGER) AS worker, s_suppkey FROM p JOIN s USING (k)
"""


def worker_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in batches of 32 slots that four workers fill."""
    part = tables(spark, sf_dir, "part")["part"].select("p_partkey")
    return S.worker_batches(part, 32, 4, id_col="p_partkey").select("p_partkey", "worker", "batch", "slot", "partly_filled")


WORKER_SLOTS = f"""
WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY {_u('0, p_partkey')}, p_partkey) - 1 AS i FROM part),
w AS (SELECT p_partkey, CAST(i % 4 AS INTEGER) AS worker, i // 4 AS j FROM o)
SELECT p_partkey, worker, j // 8 AS batch, CAST(worker * 8 + j % 8 AS INTEGER) AS slot, count(*) OVER (PARTITION BY worker, j // 8) < 8 AS partly_filled FROM w
"""


def whole_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each supplier in random parts of 16, without what is left over."""
    t = tables(spark, sf_dir, "lineitem")["lineitem"].select("l_suppkey", "l_orderkey", "l_linenumber")
    return S.whole_parts(t, "l_suppkey", ["l_orderkey", "l_linenumber"], 16).select("l_suppkey", "l_orderkey", "l_linenumber", "part")


WHOLE_PARTS = f"""
WITH o AS (
    SELECT l_suppkey, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS n,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY {_u('0, l_suppkey, l_orderkey, l_linenumber')}, l_orderkey, l_linenumber) - 1 AS i FROM lineitem
)
SELECT l_suppkey, l_orderkey, l_linenumber, i // 16 AS part FROM o WHERE i < n // 16 * 16
"""


def valid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' line items with an erased run of lines, in the first attempt that leaves most of an image valid."""
    t = tables(spark, sf_dir, "lineitem")["lineitem"]
    cells = t.select(F.col("l_suppkey").alias("image"), "l_orderkey", "l_linenumber", F.lit(True).alias("valid"))
    erase = lambda c: c.withColumn("valid", F.col("l_linenumber") != F.floor(F.col("u") * 7) + 1)
    registry = E.Registry()
    registry.add(E.Transformation("erase", erase, ("u",), 100 * F.count_if("valid") >= 82 * F.count("*")))
    out = registry.apply(cells, "image", ["erase"], attempts=12)
    return out.groupBy("image").agg(F.count_if("valid").alias("n_valid"), F.count("*").alias("n"))


VALID_REGIONS = f"""
WITH i AS (SELECT DISTINCT l_suppkey AS image FROM lineitem),
a AS (SELECT image, k AS attempt, {_u("0, '0/0/erase', image, k, 'u'")} AS u FROM i, unnest(range(12)) t(k)),
j AS (SELECT image, attempt, count(*) FILTER (l_linenumber <> floor(u * 7) + 1) AS n_valid, count(*) AS n FROM a JOIN lineitem ON l_suppkey = image GROUP BY 1, 2),
f AS (SELECT image, n_valid, n, row_number() OVER (PARTITION BY image ORDER BY attempt) AS r FROM j WHERE 100 * n_valid >= 82 * n)
SELECT image, n_valid, n FROM f WHERE r = 1
"""


def bootstrapped_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True positive rates of 20 bootstraps of customers at 11 thresholds: does a large price tell a closed order?"""
    o = tables(spark, sf_dir, "orders")["orders"]
    rows = o.select(F.col("o_custkey").alias("unit"), F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    out = U.bootstrapped_roc(rows, "unit", "score", "label", 20, 11)
    return out.select("bootstrap", F.round("threshold", 6).alias("threshold"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


BOOTSTRAPPED = f"""
WITH s AS (SELECT o_custkey AS unit, least(o_totalprice / 500000, 1.0) AS score, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders),
u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT unit FROM s)),
d AS (SELECT b AS bootstrap, CAST(floor({_u('0, b, p')} * n) AS BIGINT) AS p FROM u, unnest(range(20)) t(b)),
w AS (SELECT d.bootstrap, u.unit, count(*) AS k FROM d JOIN u USING (p) GROUP BY 1, 2),
c AS (SELECT bootstrap, label, greatest(-1, least(floor(score * 10 + 1e-9), 10)) AS bin, sum(k) AS k FROM w JOIN s USING (unit) GROUP BY ALL),
g AS (SELECT b AS bootstrap, t AS bin FROM unnest(range(20)) x(b), unnest(range(11)) y(t)),
r AS (
    SELECT g.bootstrap, g.bin, sum(CASE WHEN label = 1 AND c.bin >= g.bin THEN k ELSE 0 END) AS p, sum(CASE WHEN label = 0 AND c.bin >= g.bin THEN k ELSE 0 END) AS q,
           sum(CASE WHEN label = 1 THEN k ELSE 0 END) AS ps, sum(CASE WHEN label = 0 THEN k ELSE 0 END) AS qs
    FROM g JOIN c ON c.bootstrap = g.bootstrap GROUP BY 1, 2
)
SELECT CAST(bootstrap AS INTEGER) AS bootstrap, round(bin / 10.0, 6) AS threshold, round(p / ps, 6) AS tpr, round(q / qs, 6) AS fpr FROM r
"""

def patches_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of suppliers' images until each relevant cell was in one: what the stream with state draws."""
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    keys = [F.col("l_suppkey").alias("image"), F.pmod("l_orderkey", F.lit(20)).cast("int").alias("row"), F.pmod("l_partkey", F.lit(20)).cast("int").alias("col")]
    cells = li.select(*keys, F.lit(20).alias("height"), F.lit(20).alias("width"))
    return S.all_patches(S.packed_cells(cells, "image"), "image", 5, 5)


PATCHES = """
WITH RECURSIVE p AS (
    SELECT image, list({'r': r, 'c': c} ORDER BY r, c) AS free FROM (SELECT DISTINCT l_suppkey AS image, l_orderkey % 20 AS r, l_partkey % 20 AS c FROM lineitem) x GROUP BY image
), w AS (
    SELECT image, -1 AS patch, 0::BIGINT AS y, 0::BIGINT AS x, free FROM p
    UNION ALL
    SELECT image, patch + 1, y, x, list_filter(free, lambda t: NOT (t.r >= y AND t.r < y + 5 AND t.c >= x AND t.c < x + 5))
    FROM (
        SELECT image, patch, free, least(greatest(cell.r - 2, 0), 15) AS y, least(greatest(cell.c - 2, 0), 15) AS x
        FROM (SELECT image, patch, free, free[CAST('0x' || substr(md5('0,' || image || ',' || (patch + 1)), 1, 12) AS BIGINT) % len(free) + 1] AS cell FROM w WHERE len(free) > 0) a
    ) b
)
SELECT image, CAST(patch AS INTEGER) AS patch, CAST(y AS INTEGER) AS top, CAST(x AS INTEGER) AS "left" FROM w WHERE patch >= 0
"""

QUERIES = {
    "patches_at_rest": (patches_at_rest, PATCHES),
    "group_folds": (group_folds, _group_folds_sql()),
    "nested_group_folds": (nested_group_folds, None),
    "fold_partitions": (fold_partitions, FOLD_PARTITIONS),
    "vector_dependence": (vector_dependence, VECTOR_DEPENDENCE),
    "merged_documents": (merged_documents, MERGED),
    "camera_versions": (camera_versions, CAMERA_VERSIONS),
    "colour_highlights": (colour_highlights, HIGHLIGHTS),
    "stream_order": (stream_order, STREAM_ORDER),
    "worker_slots": (worker_slots, WORKER_SLOTS),
    "whole_parts": (whole_parts, WHOLE_PARTS),
    "valid_regions": (valid_regions, VALID_REGIONS),
    "bootstrapped_rates": (bootstrapped_rates, BOOTSTRAPPED),
}
