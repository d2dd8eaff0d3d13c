"""Vectors, ordered analytics, sampling and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..operators import bootstrap as B
from ..operators import cells as R
from ..operators import checks as C
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import timeline as L
from ..session import tables
from ..streaming import streams as S


#: The event type that opens spans and carries marks.
TYPE = "click"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "embeddings")["embeddings"].select("vec_id", "label", V.doubles("embedding").alias("v"))


def _long(change: Callable[[Column], Column]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _vectors(spark, sf_dir).select("vec_id", F.posexplode(change(F.col("v"))).alias("idx", "x"))
        return out.select("vec_id", "idx", F.round("x", 6).alias("x"))

    return run


def _elementwise(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = V.elementwise(_vectors(spark, sf_dir), ["label"], "v", how)
        return out.select("label", F.posexplode("v").alias("idx", "x")).select("label", "idx", F.round("x", 6).alias("x"))

    return run


_E = "WITH e AS (SELECT vec_id, label, i - 1 AS idx, CAST(embedding[i] AS DOUBLE) AS x, len(embedding) AS n FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i))"


def nearest_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    out = J.least_distance(v.where("label < 3"), v.where("label >= 3"), "vec_id", "v")
    return out.select("vec_id", F.round("min_distance", 6).alias("min_distance"))


def distance_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first and the second component of the vectors of each label."""
    v = _vectors(spark, sf_dir).select("label", "vec_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    out = M.distance_correlation(v, ["label"], "vec_id", "x", "y")
    return out.select("label", F.round("dcor", 6).alias("dcor"))


def condensed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argmax and single class above a threshold of softmax scores."""
    p = V.softmax(F.transform("v", lambda x: 10 * x))
    out = _vectors(spark, sf_dir).select("vec_id", p.alias("p"))
    return out.select("vec_id", V.argmax(F.col("p")).alias("best"), V.single_label(F.col("p"), 0.5).cast("int").alias("single"))


def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    long = li.select(F.explode(F.create_map(F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax"), F.lit("quantity"), F.col("l_quantity"))).alias("channel", "x"))
    out = S.running_statistics(long, ["channel"], "x")
    return out.select("channel", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "events")["events"]


def rel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.relative_time(_events(spark, sf_dir), ["user_id"], "ts").select("event_id", F.round("rel_time", 3).alias("rel_time"))


def first_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_dates(_events(spark, sf_dir), ["user_id", "event_type"], "ts").select("event_id")


def stable_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("half", F.col("value") > 50)
    return L.stable(e, "user_id", "ts", "half", 1).select("event_id", F.col("stable").cast("int").alias("stable"))


def moving_average_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.moving_average(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", F.round("moving", 6).alias("avg5"))


def interpolate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("hour", F.floor(L.micros("ts") / 3_600_000_000))
    # whole hundredths have exact sums, whatever the order of rows
    hundredths = F.when(F.col("event_type") != TYPE, F.round(F.col("value") * 100).cast("long"))
    sparse = e.groupBy("user_id", "hour").agg((F.try_divide(F.sum(hundredths), F.count(hundredths)) / 100).alias("value"))
    return L.interpolated(sparse, ["user_id"], "hour", "value").select("user_id", "hour", F.round("value", 6).alias("value"))


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the two hours after each purchase-like event of a user, by start event."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", L.micros("ts").alias("t"))
    spans = e.where(F.col("event_type") == TYPE).select("user_id", F.col("event_id").alias("span"), F.col("t").alias("a"), (F.col("t") + 7_200_000_000).alias("b"))
    return J.within(e, spans, "t", "a", "b", 7_200_000_000, ["user_id"]).groupBy("span").agg(F.count("*").alias("n"))


def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", L.micros("ts").alias("t"))
    marks = e.where(F.col("event_type") == TYPE).select("user_id", F.col("t").alias("r"), F.col("event_id").alias("mark"))
    marks = marks.groupBy("user_id", "r").agg(F.min("mark").alias("mark"))
    return J.nearest(e, marks, "t", "r", ["user_id"], ["mark"]).select("event_id", "mark")


def percentile_row_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables(spark, sf_dir, "orders")["orders"]
    return L.percentile_row(o, ["o_orderpriority"], ["o_totalprice", "o_orderkey"], 0.25).select("o_orderpriority", "o_orderkey")


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.running_total(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")
    return e.select("event_id", F.round("total", 4).alias("total"))


def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables(spark, sf_dir, "orders")["orders"]
    return L.best_rows(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over event time, the stream's plan on the table at rest."""
    out = S.windowed(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], "value")
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    return li.groupBy(F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("algorithm"), F.pmod("l_suppkey", F.lit(20)).alias("case")).agg(F.avg(F.round(F.col("l_discount") * 100)).alias("value"))


def _complete(df: DataFrame) -> DataFrame:
    """Tasks with two algorithms that share their cases."""
    both = df.groupBy("task", "case").agg(F.count("*").alias("n")).where("n = 2").drop("n")
    return df.join(both, ["task", "case"])


def bootstrap_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rank_counts(B.ranking(_complete(_cases(spark, sf_dir)), "task", "algorithm", "case", "value", 200), "task", "algorithm")


def bootstrap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.rank_statistics(B.ranking(_complete(_cases(spark, sf_dir)), "task", "algorithm", "case", "value", 200), "task", "algorithm")
    return out.select("task", "algorithm", "low", "high", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir)
    out = B.interval(B.bootstrapped(rows, ["task"], "case", F.avg("value"), 100), ["task"])
    return out.select("task", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "low", "high")])


def hierarchical_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "orders", "customer")
    rows = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return B.hierarchical(rows, "c_nationkey", "o_custkey", "o_orderkey", 20, 5, 4)


def balanced_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.balanced(tables(spark, sf_dir, "part")["part"], "p_type", "p_partkey", 20, 60)


def oversampled_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .corpus import stats

    return B.oversampled(stats(spark, sf_dir), "label_name", "image_name", 10, 50)


def weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.weighted_sample(tables(spark, sf_dir, "part")["part"], ["p_type"], "p_size", 10, "p_partkey").select("p_type", "p_partkey")


def sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.sample_batches(tables(spark, sf_dir, "part")["part"].select("p_partkey"), 32, 2, id_col="p_partkey")
    return out.select("epoch", "batch", "p_partkey")


def worker_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt to four workers by stride and by runs."""
    part = tables(spark, sf_dir, "part")["part"].select("p_partkey")
    by = S.worker_share(part, 4, id_col="p_partkey").join(S.worker_share(part, 4, False, "p_partkey").withColumnRenamed("worker", "run"), "p_partkey")
    return by.select("p_partkey", "worker", "run")


def patch_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of suppliers' images, in proportion to the images' sizes."""
    s = tables(spark, sf_dir, "supplier")["supplier"].select(F.col("s_suppkey").alias("image"), (10 + F.col("s_suppkey") % 20).cast("int").alias("h"), (12 + F.col("s_suppkey") % 7).cast("int").alias("w"))
    return S.patch_places(s, "image", "h", "w", 5, 6, 500)


def folds_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.nested_folds(tables(spark, sf_dir, "orders")["orders"], "o_custkey", "o_orderstatus", 3, 2)


def folds_subset_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.subset_series(tables(spark, sf_dir, "nation")["nation"], "n_nationkey", [1, 3, 8], 4, 12)


def colour_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as colours and back, counted by colour."""
    cells = _cells(spark, sf_dir)
    colours = cells.select("label").distinct().select("label", *[F.pmod(F.col("label") * m, F.lit(256)).cast("int").alias(c) for c, m in (("r", 37), ("g", 91), ("b", 200))])
    seen = R.labels_of_colours(R.colours_of_labels(cells, colours).select("image", "r", "g", "b"), colours)
    return seen.groupBy("label", "r", "g", "b").agg(F.count("*").alias("n"))


def mixed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors mixed with a shuffled partner's, by their sums."""
    v = _vectors(spark, sf_dir).select("vec_id", "v", F.col("label").cast("int").alias("label"), (F.col("vec_id") % 3 > 0).alias("valid"))
    out = R.mix_up(v, "vec_id", ["v"], 0.75, 0, ["label"], 4, "valid")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", F.round(total("v"), 5).alias("total"), F.round(F.get("label", F.lit(1)), 6).alias("label_1"), F.col("valid").cast("int").alias("valid"))


def folds_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "customer", "nation")
    out = C.leave_one_out(t["customer"], "c_nationkey", "c_custkey")
    return out.groupBy("fold_name", "split_name").agg(F.count("*").alias("n"))


def folds_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir, "customer")["customer"]
    folds = c.select(F.concat(F.lit("f"), (F.col("c_nationkey") % 5).cast("string")).alias("fold_name"), "c_nationkey").distinct()
    return C.grouped_folds(c, folds, "c_nationkey", "c_custkey").groupBy("fold_name", "split_name").agg(F.count("*").alias("n"))


def folds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stratified_folds(tables(spark, sf_dir, "orders")["orders"], "o_custkey", "o_orderstatus", 4).groupBy("fold").agg(F.count("*").alias("n"))


def pair_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir, "part")["part"]
    out = R.pairs_by_label(p, "p_type", F.col("p_size") <= 3, F.col("p_size") >= 49, "p_partkey")
    return out.select("p_type", "first", "second")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    keys = [F.col("l_suppkey").alias("image"), F.pmod("l_orderkey", F.lit(20)).cast("int").alias("row"), F.pmod("l_partkey", F.lit(20)).cast("int").alias("col")]
    return li.groupBy(*keys).agg(F.min("l_linenumber").alias("label"), F.max("l_quantity").alias("value"))


def cells_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut into tiles and put together again."""
    return R.untiled(R.tiles(_cells(spark, sf_dir), 7, 6), 7, 6, 20, 20).select("image", "row", "col", "label", "value")


def _changed(change: Callable[[DataFrame], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return change(_cells(spark, sf_dir)).select("image", "row", "col", "label", "value")

    return run


def cells_blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blank(_cells(spark, sf_dir), F.col("label") == 2).select("image", "row", "col", "label", "value")


def curve_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).groupBy("user_id", F.col("value").cast("double").alias("x")).agg(F.count("*").cast("double").alias("y"))
    out = M.curve_on_grid(e, ["user_id"], "x", "y", 0.0, 95.0, 20)
    return out.select("user_id", "at", "x", F.round("y", 6).alias("y"))


def sample_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.patches(_cells(spark, sf_dir), "image", 5, 5, 4)


def _u(parts: str) -> str:
    """The oracle's spelling of ``bootstrap.uniform`` over a list of parts, the seed first."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 13) AS BIGINT) / 4503599627370496.0)"


_CELLS = "WITH cells AS (SELECT l_suppkey AS image, CAST(l_orderkey % 20 AS INTEGER) AS row, CAST(l_partkey % 20 AS INTEGER) AS col, min(l_linenumber) AS label, max(l_quantity) AS value FROM lineitem GROUP BY ALL)"
_CHOSEN = _CELLS + f", l AS (SELECT image, list_sort(list(DISTINCT label)) AS l FROM cells WHERE label < 5 GROUP BY 1), ch AS (SELECT image, l[CAST(floor({_u('0, image')} * len(l)) AS INTEGER) + 1] AS c FROM l)"
_NEXT = f", o AS (SELECT image, row_number() OVER (ORDER BY {_u('2, image')}, image) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT image FROM cells)), t AS (SELECT a.image, b.image AS donor FROM o a JOIN o b ON (b.i - 1 + b.n) % b.n = a.i)"
_KINDS = "WITH k AS (SELECT o_custkey AS s, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kind, count(*) AS n FROM orders GROUP BY 1)"
_CASES = "WITH cases AS (SELECT l_returnflag AS task, l_linestatus AS algorithm, l_suppkey % 20 AS c, avg(round(l_discount * 100)) AS value FROM lineitem GROUP BY ALL)"
_RANKED = (
    _CASES
    + f", f AS (SELECT * FROM cases SEMI JOIN (SELECT task, c FROM cases GROUP BY ALL HAVING count(*) = 2) USING (task, c)), p AS (SELECT task, c, row_number() OVER (PARTITION BY task ORDER BY c) - 1 AS p, count(*) OVER (PARTITION BY task) AS n FROM (SELECT DISTINCT task, c FROM f)),"
    + f" d AS (SELECT task, b, CAST(floor({_u('0, task, b, p')} * n) AS BIGINT) AS pick FROM p, unnest(range(200)) t(b)), m AS (SELECT d.task, b, algorithm, avg(value) AS score FROM d JOIN p ON p.task = d.task AND p.p = pick JOIN f ON f.task = p.task AND f.c = p.c GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY task, b ORDER BY score DESC) AS rank FROM m)"
)


QUERIES = {
    "l1_norm": (_long(lambda v: V.normalised(v, 1)), _E + " SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(x / sum(abs(x)) OVER (PARTITION BY vec_id), 6) + 0.0 AS x FROM e"),
    "l2_norm": (_long(lambda v: V.normalised(v, 2)), _E + " SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) + 0.0 AS x FROM e"),
    "snv": (_long(V.standard_normal_variate), _E + " SELECT vec_id, CAST(idx AS INTEGER) AS idx, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) + 0.0 AS x FROM e WINDOW w AS (PARTITION BY vec_id)"),
    "split_scaled": (_long(V.split_scaled), _E + " SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(CASE WHEN x > 0 THEN x / max(x) OVER w WHEN x < 0 THEN -x / min(x) OVER w ELSE 0 END, 6) + 0.0 AS x FROM e WINDOW w AS (PARTITION BY vec_id)"),
    "spectrum_gradient": (_long(V.gradient), _E + " SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(CASE WHEN idx = 0 THEN lead(x) OVER w - x WHEN idx = n - 1 THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END, 6) + 0.0 AS x FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY idx)"),
    "vector_mean": (_elementwise("mean"), _E + " SELECT label, CAST(idx AS INTEGER) AS idx, round(avg(x), 6) + 0.0 AS x FROM e GROUP BY label, idx"),
    "vector_median": (_elementwise("median"), _E + " SELECT label, CAST(idx AS INTEGER) AS idx, round(median(x), 6) + 0.0 AS x FROM e GROUP BY label, idx"),
    "vector_std": (_elementwise("std"), _E + " SELECT label, CAST(idx AS INTEGER) AS idx, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(x) END, 6) + 0.0 AS x FROM e GROUP BY label, idx"),
    "nearest_vector": (nearest_vector, _E + ", d AS (SELECT a.vec_id, b.vec_id AS other, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM e a JOIN e b ON a.idx = b.idx AND a.label < 3 AND b.label >= 3 GROUP BY ALL) SELECT vec_id, round(min(d), 6) AS min_distance FROM d GROUP BY vec_id"),
    "distance_correlation": (
        distance_correlation,
        "WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, abs(a.x - b.x) AS a, abs(a.y - b.y) AS b FROM v a JOIN v b USING (label)), c AS (SELECT label, a - avg(a) OVER (PARTITION BY label, i) - avg(a) OVER (PARTITION BY label, j) + avg(a) OVER (PARTITION BY label) AS a, b - avg(b) OVER (PARTITION BY label, i) - avg(b) OVER (PARTITION BY label, j) + avg(b) OVER (PARTITION BY label) AS b FROM p) SELECT label, round(sqrt(greatest(avg(a * b), 0)) / sqrt(sqrt(avg(a * a) * avg(b * b))), 6) AS dcor FROM c GROUP BY label",
    ),
    "condensed_labels": (condensed_labels, "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: exp(10 * CAST(x AS DOUBLE))) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s) SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS best, CASE WHEN list_max(p) > 0.5 THEN CAST(list_position(p, list_max(p)) - 1 AS INTEGER) ELSE -1 END AS single FROM p"),
    "running_stats": (running_stats, "SELECT channel, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT 'discount' AS channel, l_discount AS x FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem) GROUP BY channel"),
    "rel_time": (rel_time, "SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 3) AS rel_time FROM events"),
    "first_inclusion": (first_inclusion, "SELECT event_id FROM (SELECT event_id, rank() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE)) AS r FROM events) WHERE r = 1"),
    "stable_window": (stable_window, "WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, value > 50 AS h FROM events) SELECT a.event_id, CAST(count(DISTINCT b.h) = 1 AS INTEGER) AS stable FROM e a JOIN e b ON a.user_id = b.user_id AND b.d BETWEEN a.d AND a.d + 1 GROUP BY a.event_id"),
    "moving_average_valid": (moving_average_valid, "SELECT event_id, avg5 FROM (SELECT event_id, round(avg(value) OVER (w ROWS 4 PRECEDING), 6) AS avg5, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k >= 5"),
    "interpolate_gaps": (
        interpolate_gaps,
        "WITH h AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, CAST(sum(CASE WHEN event_type <> 'click' THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) / count(CASE WHEN event_type <> 'click' THEN 1 END) / 100 AS v FROM events GROUP BY ALL), n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN hour END IGNORE NULLS) OVER b AS bh, last_value(v IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN v IS NOT NULL THEN hour END IGNORE NULLS) OVER a AS ah, first_value(v IGNORE NULLS) OVER a AS av FROM h WINDOW b AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, hour, round(CASE WHEN v IS NOT NULL THEN v WHEN bh IS NULL THEN av WHEN ah IS NULL THEN bv ELSE bv + (av - bv) * (hour - bh) / (ah - bh) END, 6) AS value FROM n",
    ),
    "interval_join": (interval_join, "SELECT s.event_id AS span, count(*) AS n FROM events s JOIN events e ON s.user_id = e.user_id AND epoch_us(e.ts) BETWEEN epoch_us(s.ts) AND epoch_us(s.ts) + 7200000000 WHERE s.event_type = 'click' GROUP BY 1"),
    "nearest_join": (nearest_join, "WITH m AS (SELECT user_id, epoch_us(ts) AS r, min(event_id) AS mark FROM events WHERE event_type = 'click' GROUP BY ALL), j AS (SELECT e.event_id, mark, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(e.ts) - r), r) AS k FROM events e LEFT JOIN m USING (user_id)) SELECT event_id, mark FROM j WHERE k = 1"),
    "percentile_row_pick": (percentile_row_pick, "WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, o_orderkey FROM r WHERE i = CAST(round_even(0.25 * n, 0) AS BIGINT)"),
    "running_totals": (running_totals, "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events"),
    "top_rows": (top_rows, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3"),
    "event_windows": (event_windows, "SELECT date_trunc('hour', ts) AS \"start\", event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL"),
    "folds_leave_one_out": (folds_leave_one_out, "WITH c AS (SELECT c_nationkey AS s FROM customer) SELECT 'fold_' || d.s AS fold_name, CASE WHEN c.s = d.s THEN 'val' ELSE 'train' END AS split_name, count(*) AS n FROM c, (SELECT DISTINCT s FROM c) d GROUP BY ALL"),
    "folds_grouped": (folds_grouped, "WITH f AS (SELECT DISTINCT c_nationkey % 5 AS f FROM customer), c AS (SELECT c_nationkey AS s, c_nationkey % 5 AS own, row_number() OVER (PARTITION BY c_nationkey) AS k FROM customer) SELECT 'f' || f AS fold_name, CASE WHEN own = f THEN 'val' WHEN k = 1 THEN 'val_known' ELSE 'train' END AS split_name, count(*) AS n FROM c, f GROUP BY ALL"),
    "pair_enumeration": (pair_enumeration, "SELECT a.p_type, a.p_partkey AS \"first\", b.p_partkey AS \"second\" FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size <= 3 AND b.p_size >= 49"),
    "cells_tiled": (cells_tiled, "SELECT l_suppkey AS image, CAST(l_orderkey % 20 AS INTEGER) AS \"row\", CAST(l_partkey % 20 AS INTEGER) AS col, min(l_linenumber) AS label, max(l_quantity) AS value FROM lineitem GROUP BY ALL"),
    "cells_blanked": (cells_blanked, "SELECT l_suppkey AS image, CAST(l_orderkey % 20 AS INTEGER) AS \"row\", CAST(l_partkey % 20 AS INTEGER) AS col, CASE WHEN min(l_linenumber) = 2 THEN 100 ELSE min(l_linenumber) END AS label, CASE WHEN min(l_linenumber) = 2 THEN 0 ELSE max(l_quantity) END AS value FROM lineitem GROUP BY ALL"),
    "cells_removed": (_changed(lambda c: R.remove_label(c, "image", F.col("label") < 5)), _CHOSEN + " SELECT image, row, col, CASE WHEN label = c THEN 100 ELSE label END AS label, CASE WHEN label = c THEN 0 ELSE value END AS value FROM cells LEFT JOIN ch USING (image)"),
    "cells_isolated": (_changed(lambda c: R.remove_label(c, "image", F.col("label") < 5, isolate=True)), _CHOSEN + " SELECT image, row, col, CASE WHEN label <> c THEN 100 ELSE label END AS label, CASE WHEN label <> c THEN 0 ELSE value END AS value FROM cells LEFT JOIN ch USING (image)"),
    "cells_hidden": (_changed(lambda c: R.hide_and_seek(c, "image", 5, 5, 6, 16)), _CELLS + f", a AS (SELECT image, max(col // 5) + 1 AS across FROM cells GROUP BY 1), h AS (SELECT DISTINCT image, CAST(floor({_u('0, image, k')} * 16) AS BIGINT) AS p FROM (SELECT DISTINCT image FROM cells) i, unnest(range(1, 7)) t(k)), x AS (SELECT cells.*, h.p IS NOT NULL AS hit FROM cells JOIN a USING (image) LEFT JOIN h ON h.image = cells.image AND h.p = (row // 5) * across + col // 5) SELECT image, row, col, CASE WHEN hit THEN 100 ELSE label END AS label, CASE WHEN hit THEN 0 ELSE value END AS value FROM x"),
    "cells_erased": (_changed(lambda c: R.erase_rectangle(c, "image", 6, 8, 20, 20)), _CELLS + f", x AS (SELECT *, row BETWEEN floor({_u('0, image, chr(114)')} * 15) AND floor({_u('0, image, chr(114)')} * 15) + 5 AND col BETWEEN floor({_u('0, image, chr(99)')} * 13) AND floor({_u('0, image, chr(99)')} * 13) + 7 AS hit FROM cells) SELECT image, row, col, CASE WHEN hit THEN 100 ELSE label END AS label, CASE WHEN hit THEN 0 ELSE value END AS value FROM x"),
    "cells_transplanted": (
        _changed(lambda c: R.transplant(c, "image", F.col("label") < 5)),
        _CHOSEN + _NEXT + ", d AS (SELECT t.image, row, col, label, value FROM cells JOIN ch USING (image) JOIN t ON t.donor = cells.image WHERE label = c) SELECT cells.image, cells.row, cells.col, coalesce(d.label, cells.label) AS label, coalesce(d.value, cells.value) AS value FROM cells LEFT JOIN d ON d.image = cells.image AND d.row = cells.row AND d.col = cells.col",
    ),
    "cells_rectangle_transplanted": (
        _changed(lambda c: R.transplant_region(R.rectangles(c, "image", 6, 8, 20, 20), "image", "region")),
        _CELLS + _NEXT + f", d AS (SELECT t.image, row, col, label, value FROM cells JOIN t ON t.donor = cells.image WHERE row BETWEEN floor({_u('0, cells.image, chr(114)')} * 15) AND floor({_u('0, cells.image, chr(114)')} * 15) + 5 AND col BETWEEN floor({_u('0, cells.image, chr(99)')} * 13) AND floor({_u('0, cells.image, chr(99)')} * 13) + 7) SELECT cells.image, cells.row, cells.col, coalesce(d.label, cells.label) AS label, coalesce(d.value, cells.value) AS value FROM cells LEFT JOIN d ON d.image = cells.image AND d.row = cells.row AND d.col = cells.col",
    ),
    "cells_jigsaw": (
        _changed(lambda c: R.jigsaw(c, "image", 5, 5)),
        _CELLS + f", p AS (SELECT DISTINCT image, row // 5 AS r, col // 5 AS k FROM cells), h AS (SELECT *, row_number() OVER (ORDER BY {_u('0, image, r, k')}, image, r, k) AS i FROM p), g AS (SELECT *, row_number() OVER (ORDER BY {_u('1, image, r, k')}, image, r, k) AS i FROM p) SELECT g.image, CAST(g.r * 5 + cells.row % 5 AS INTEGER) AS row, CAST(g.k * 5 + cells.col % 5 AS INTEGER) AS col, label, value FROM cells JOIN h ON h.image = cells.image AND h.r = cells.row // 5 AND h.k = cells.col // 5 JOIN g ON g.i = h.i",
    ),
    "curve_grid": (
        curve_grid,
        "WITH e AS (SELECT user_id, CAST(value AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY ALL), n AS (SELECT user_id, count(*) AS n, min(x) AS x, min(y) AS y FROM e GROUP BY 1), g AS (SELECT CAST(i AS INTEGER) AS p, 5.0::DOUBLE * i AS gx FROM unnest(range(20)) t(i)), b AS (SELECT user_id, p, gx, max(x) FILTER (x <= gx) AS lo, min(x) FILTER (x >= gx) AS hi FROM e, g GROUP BY ALL), j AS (SELECT b.*, l.y AS ly, h.y AS hy, n, n.x AS only_x, n.y AS only_y FROM b JOIN n USING (user_id) LEFT JOIN e l ON l.user_id = b.user_id AND l.x = lo LEFT JOIN e h ON h.user_id = b.user_id AND h.x = hi) SELECT user_id, p AS \"at\", gx AS x, round(CASE WHEN n = 1 THEN CASE WHEN p = (SELECT arg_min(g.p, abs(g.gx - only_x) + g.p * 1e-9) FROM g) THEN only_y ELSE 'nan'::DOUBLE END WHEN lo IS NULL OR hi IS NULL THEN 'nan'::DOUBLE WHEN lo = hi THEN ly ELSE ly + (hy - ly) * (gx - lo) / (hi - lo) END, 6) AS y FROM j",
    ),
    "sample_patches": (sample_patches, None),
    "folds_stratified": (folds_stratified, _KINDS + f", f AS (SELECT s, CAST((row_number() OVER (PARTITION BY kind ORDER BY n DESC, s) - 1 + floor({_u('0, kind')} * 4)) % 4 AS INTEGER) AS fold FROM k) SELECT fold, count(*) AS n FROM f GROUP BY 1"),
    "folds_nested": (
        folds_nested,
        _KINDS + f", f AS (SELECT k.*, CAST((row_number() OVER (PARTITION BY kind ORDER BY n DESC, s) - 1 + floor({_u('0, kind')} * 3)) % 3 AS INTEGER) AS own FROM k), o AS (SELECT f.*, CAST(u AS INTEGER) AS outer_fold, (row_number() OVER (PARTITION BY u, kind, own = u ORDER BY n DESC, s) - 1) % 2 AS inn FROM f, unnest(range(3)) t(u)) SELECT s AS o_custkey, outer_fold, CAST(i AS INTEGER) AS fold, CASE WHEN own = outer_fold THEN 'test' WHEN inn = i THEN 'val' ELSE 'train' END AS split FROM o, unnest(range(2)) t(i)",
    ),
    "folds_subset_series": (
        folds_subset_series,
        f"WITH p AS (SELECT n_nationkey AS s, t, row_number() OVER (PARTITION BY t ORDER BY {_u('0, t, n_nationkey')}, n_nationkey) AS k FROM nation, unnest(range(12)) r(t)), q AS (SELECT z, t, list(s ORDER BY s) AS l FROM p, (VALUES (1), (3), (8)) v(z) WHERE k <= z GROUP BY ALL), f AS (SELECT z, l, min(t) AS t FROM q GROUP BY ALL), c AS (SELECT z, l, row_number() OVER (PARTITION BY z ORDER BY t) - 1 AS seed FROM f) SELECT z AS \"size\", CAST(seed AS INTEGER) AS seed, unnest(l) AS n_nationkey FROM c WHERE seed < 4",
    ),
    "worker_shares": (worker_shares, f"WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY {_u('0, p_partkey')}, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, CAST(i % 4 AS INTEGER) AS worker, CAST(floor(i * 4 / n) AS INTEGER) AS run FROM o"),
    "patch_positions": (
        patch_positions,
        f"WITH i AS (SELECT s_suppkey AS image, CAST(10 + s_suppkey % 20 AS INTEGER) AS h, CAST(12 + s_suppkey % 7 AS INTEGER) AS w FROM supplier), n AS (SELECT image, h, w, CAST(floor(CAST((h - 4) * (w - 5) AS DOUBLE) / sum((h - 4) * (w - 5)) OVER () * 500 + {_u('0, image, chr(110)')}) AS INTEGER) AS n FROM i) SELECT image, CAST(k AS INTEGER) AS patch, CAST(floor({_u('0, image, k, chr(114)')} * (h - 4)) AS INTEGER) AS top, CAST(floor({_u('0, image, k, chr(99)')} * (w - 5)) AS INTEGER) AS \"left\" FROM n, unnest(range(n)) t(k)",
    ),
    "colour_masks": (colour_masks, _CELLS + " SELECT label, CAST(label * 37 % 256 AS INTEGER) AS r, CAST(label * 91 % 256 AS INTEGER) AS g, CAST(label * 200 % 256 AS INTEGER) AS b, count(*) AS n FROM cells GROUP BY label"),
    "mixed_vectors": (
        mixed_vectors,
        f"WITH v AS (SELECT vec_id, label, vec_id % 3 > 0 AS ok, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS t FROM embeddings), a AS (SELECT *, row_number() OVER (ORDER BY {_u('0, vec_id')}, vec_id) AS k FROM v), b AS (SELECT *, row_number() OVER (ORDER BY {_u('1, vec_id')}, vec_id) AS k FROM v) SELECT a.vec_id, round(0.75 * a.t + 0.25 * b.t, 5) AS total, round(0.75 * CAST(a.label = 1 AS INTEGER) + 0.25 * CAST(b.label = 1 AS INTEGER), 6) AS label_1, CAST(a.ok AND b.ok AS INTEGER) AS valid FROM a JOIN b USING (k)",
    ),
    "bootstrap_ranking": (bootstrap_ranking, _RANKED + " SELECT task, algorithm, CAST(rank AS INTEGER) AS rank, count(*) AS n FROM r GROUP BY ALL"),
    "bootstrap_statistics": (
        bootstrap_statistics,
        _RANKED + ", o AS (SELECT *, row_number() OVER (PARTITION BY task, algorithm ORDER BY rank, b) AS i, count(*) OVER (PARTITION BY task, algorithm) AS n FROM r) SELECT task, algorithm, CAST(max(rank) FILTER (i = greatest(1, round_even(0.025 * n, 0))) AS INTEGER) AS low, CAST(max(rank) FILTER (i = greatest(1, round_even(0.975 * n, 0))) AS INTEGER) AS high, round(avg(rank), 6) AS mean, round(median(rank), 6) AS median, round(stddev_pop(rank), 6) AS std FROM o GROUP BY ALL",
    ),
    "bootstrap_interval": (
        bootstrap_interval,
        _CASES + f", p AS (SELECT task, c, row_number() OVER (PARTITION BY task ORDER BY c) - 1 AS p, count(*) OVER (PARTITION BY task) AS n FROM (SELECT DISTINCT task, c FROM cases)), d AS (SELECT task, b, p AS draw, CAST(floor({_u('0, task, b, p')} * n) AS BIGINT) AS pick FROM p, unnest(range(100)) t(b)), m AS (SELECT d.task, b, avg(value) AS m FROM d JOIN p ON p.task = d.task AND p.p = pick JOIN cases ON cases.task = p.task AND cases.c = p.c GROUP BY ALL) SELECT task, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(stddev_samp(m), 6) AS std, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1",
    ),
    "hierarchical_bootstrap": (
        hierarchical_bootstrap,
        f"WITH r AS (SELECT c_nationkey AS d, o_custkey AS s, o_orderkey AS i FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT d, s, row_number() OVER (PARTITION BY d ORDER BY s) - 1 AS p, count(*) OVER (PARTITION BY d) AS n FROM (SELECT DISTINCT d, s FROM r)), i AS (SELECT d, s, i, row_number() OVER (PARTITION BY d, s ORDER BY i) - 1 AS q, count(*) OVER (PARTITION BY d, s) AS m FROM r), w AS (SELECT d, n, b, k, CAST(floor({_u('0, d, b, k')} * n) AS BIGINT) AS p FROM (SELECT DISTINCT d, n FROM s), unnest(range(20)) t(b), unnest(range(5)) u(k)), x AS (SELECT w.d, b, k, s.s, m FROM w JOIN s ON s.d = w.d AND s.p = w.p JOIN (SELECT DISTINCT d, s, m FROM i) c ON c.d = w.d AND c.s = s.s), y AS (SELECT d, b, s, CAST(floor({_u('1, d, b, k, j')} * m) AS BIGINT) AS q FROM x, unnest(range(4)) t(j)) SELECT CAST(b AS INTEGER) AS bootstrap, y.d AS c_nationkey, y.s AS o_custkey, i.i AS o_orderkey FROM y JOIN i ON i.d = y.d AND i.s = y.s AND i.q = y.q",
    ),
    "balanced_bootstrap": (
        balanced_bootstrap,
        f"WITH l AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS l, count(*) OVER () AS total FROM (SELECT DISTINCT p_type FROM part)), p AS (SELECT part.p_type, l, total, p_partkey, row_number() OVER (PARTITION BY part.p_type ORDER BY p_partkey) - 1 AS p, count(*) OVER (PARTITION BY part.p_type) AS n FROM part JOIN l ON l.p_type = part.p_type), d AS (SELECT b, w, w % (SELECT max(total) FROM l) AS l FROM unnest(range(20)) t(b), unnest(range(60)) u(w)), k AS (SELECT b, w, d.l, CAST(floor({_u('0, b, w')} * n) AS BIGINT) AS p FROM d JOIN (SELECT DISTINCT l, n FROM p) c ON c.l = d.l) SELECT CAST(b AS INTEGER) AS bootstrap, CAST(w AS INTEGER) AS draw, p_type, p_partkey FROM k JOIN p ON p.l = k.l AND p.p = k.p",
    ),
    "oversampled_bootstrap": (oversampled_bootstrap, None),
    "weighted_sampling": (weighted_sampling, f"WITH k AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY -ln(greatest({_u('0, p_partkey')}, 1e-300)) / p_size, p_partkey) AS r FROM part WHERE p_size > 0) SELECT p_type, p_partkey FROM k WHERE r <= 10"),
    "sample_stream": (sample_stream, f"WITH o AS (SELECT CAST(e AS INTEGER) AS epoch, p_partkey, row_number() OVER (PARTITION BY e ORDER BY {_u('0, e, p_partkey')}, p_partkey) - 1 AS i FROM part, unnest(range(2)) t(e)) SELECT epoch, i // 32 AS batch, p_partkey FROM o"),
}
