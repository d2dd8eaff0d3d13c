"""Quality rules: base limits and robust multivariate outliers, in DataFrame operations only.

Each text has five transformed statistics.  For every language and source a
minimum-covariance-determinant estimate describes the ordinary texts: starting
from medians and quartiles, concentration steps keep the three quarters of a
group's texts that are nearest in Mahalanobis distance and take their mean and
covariance anew, which lowers the determinant each time.  A text that is not among
the nearest three quarters of its language, by the distance from its own group, is
left out as well, so that a few odd texts can't carry a small group.  A text beyond
the chi-squared limit of its group is rejected.

Every group has an estimate of its own at every size.  Its mean and covariance are
shrunk towards its language's with the weight of ``SHRINK`` texts, and those of the
language towards those of all texts, so that few texts lean on what is like them
and many hardly do.  Estimates go to the rows by broadcast where their measured size
allows it, so that a large group stays spread over its scan's tasks; beyond that they are
joined by shuffle, where Spark's skew join splits a large group.  A group's threshold comes from a histogram of distances
and its moments from sums, so the largest group is pre-aggregated in every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, text_column

MIN_WORDS = 50
#: Per cent of words in repeated windows beyond which a text fails.
MAX_REPEAT = 50
#: Texts that the wider estimate counts for in a narrower one.
SHRINK = 50
STEPS = 4
SHARE = 0.75
#: Chi-squared with 5 degrees of freedom at an upper tail of 1e-6, and
#: the factor that makes the covariance of the nearest three quarters consistent.
LIMIT, CONSISTENT = 36.9, 1.41
#: Names of the transformed statistics, and the least standard deviation each is given:
#: differences below it never count as unusual, even if a group's texts are all alike.
VECTOR = {"x_words": 1.0, "x_length": 0.08, "x_symbols": 0.3, "x_lines": 0.15, "x_repeat": 0.15}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_X, _GROUP = list(VECTOR), ["_lang", "_source"]
_PAIRS = [(i, j) for i in range(len(_X)) for j in range(i + 1)]


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the five statistics of every whole text; a null text has no words."""
    text = text_column(docs, text_col)
    step = docs.withColumn("_w", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    step = step.withColumn("n_words", F.size("_w").cast("long"))
    step = step.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    step = step.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    step = step.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    step = step.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).withColumn("n_lines", F.size("_l").cast("long"))
    # windows of three words, by hash
    window = F.transform(F.slice("_w", F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))
    step = step.withColumn("_h", window)
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.withColumn("_s", F.when(some, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    again = F.filter("_s", lambda e, i: (F.get("_s", i + 1)["h"] == e["h"]) | ((i > 0) & (F.get("_s", F.greatest(i - 1, F.lit(0)))["h"] == e["h"])))
    step = step.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(again, lambda e: e["i"]))))
    # a repeated window covers its three words, or as far as the next one begins
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return step.drop("_w", "_l", "_h", "_s", "_p")


def base_failed(min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def _vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "x_words": F.log(words.cast("double")),
        "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "x_symbols": F.log1p(20 * F.col("n_symbols") / words),
        "x_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "x_repeat": F.col("n_repeat_words") / words,
    }


def _distance() -> Column:
    """Squared Mahalanobis distance of a row from its group's m* and triangular factor c*."""
    solved: list[Column] = []
    for i, x in enumerate(_X):
        rest = F.col(x) - F.col(f"m{i}")
        for j, y in enumerate(solved):
            rest = rest - F.col(f"c{i}{j}") * y
        solved.append(rest / F.col(f"c{i}{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def _factor(moments: DataFrame) -> DataFrame:
    """Cholesky factor of each group's covariance, with the least deviations added."""
    out = moments
    floors = list(VECTOR.values())
    for i, j in _PAIRS:
        value = F.greatest(F.col(f"s{i}{j}"), F.lit(0.0)) * CONSISTENT + floors[i] ** 2 if i == j else F.col(f"s{i}{j}") * CONSISTENT
        for k in range(j):
            value = value - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
        out = out.withColumn(f"c{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"c{j}{j}"))
    return out.select(*_GROUP, *[f"m{i}" for i in range(len(_X))], *[f"c{i}{j}" for i, j in _PAIRS])


def estimates(scratch: Scratch, rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """For every (lang, source) of ``rows`` the estimate that judges it.

    ``rows``: written rows with ``_lang``, ``_source`` and the vector, of texts that passed the base limits.
    """
    quartiles = rows.groupBy(*_GROUP).agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in _X])
    start = [F.col(x)[1].alias(f"m{i}") for i, x in enumerate(_X)]
    zero = [(F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(VECTOR[x])) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS for x in [_X[i]]]
    now = scratch.write(quartiles.select(*_GROUP, *start, *zero))
    for _ in range(steps):
        placed = rows.join(bounded(now), _GROUP).select(*_GROUP, *_X, F.least(F.floor(16 * F.log2(1 + _distance())), F.lit(1000)).cast("int").alias("bin"))
        # written, so that the counts are dealt by group and bin, not by the largest group
        binned = scratch.write(placed.groupBy(*_GROUP, "bin").agg(F.count("*").alias("n")))
        of_lang = _edge(binned.groupBy("_lang", "bin").agg(F.sum("n").alias("n")), ["_lang"]).select("_lang", F.col("edge").alias("wide"))
        limit = F.least("edge", F.greatest("wide", "low"))
        edge = scratch.write(_edge(binned, _GROUP).join(of_lang, "_lang").select(*_GROUP, limit.alias("edge")))
        near = placed.join(bounded(edge), _GROUP).where("bin <= edge")
        sums = [F.count("*").alias("n"), *[F.sum(x).alias(f"t{i}") for i, x in enumerate(_X)], *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"u{i}{j}") for i, j in _PAIRS]]
        now = scratch.write(_factor(_shrunk(scratch.write(near.groupBy(*_GROUP).agg(*sums)))))
    return now


def _edge(binned: DataFrame, keys: list[str]) -> DataFrame:
    """The bin up to which a group's nearest ``SHARE`` of texts go, and its first bin; a row for each bin comes in."""
    upto = binned.withColumn("below", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return upto.where(F.col("below") < SHARE * F.col("all")).groupBy(*keys).agg(F.max("bin").alias("edge"), F.min("bin").alias("low"))


def _shrunk(sums: DataFrame) -> DataFrame:
    """Means m* and covariances s* of each group from its sums, leaning on its language's and those on all."""
    names = ["n", *[f"t{i}" for i in range(len(_X))], *[f"u{i}{j}" for i, j in _PAIRS]]
    total = [F.sum(x).alias(x) for x in names]

    def moments(row) -> dict[str, Column]:
        mean = {f"m{i}": row(f"t{i}") / row("n") for i in range(len(_X))}
        return mean | {f"s{i}{j}": row(f"u{i}{j}") / row("n") - mean[f"m{i}"] * mean[f"m{j}"] for i, j in _PAIRS}

    lean = lambda row, own, wider: {k: (row("n") * v + SHRINK * wider[k]) / (row("n") + SHRINK) for k, v in own.items()}
    of_all = sums.agg(*total).first()
    whole = {k: F.lit(v) for k, v in moments(lambda x: float(of_all[x] or 0)).items()} if of_all["n"] else {k: F.lit(0.0) for k in moments(F.col)}
    languages = sums.groupBy("_lang").agg(*total)
    languages = languages.select("_lang", *[v.alias(f"l{k}") for k, v in lean(F.col, moments(F.col), whole).items()])
    shrunk = lean(F.col, moments(F.col), {k: F.col(f"l{k}") for k in whole})
    return sums.join(languages, "_lang").select(*_GROUP, *[v.alias(k) for k, v in shrunk.items()])


def _judged(scratch: Scratch, written: DataFrame) -> DataFrame:
    """Rows with statistics, language and source get ``base_failed`` and ``kept``."""
    rows = written.select("_lang", "_source", base_failed().alias("_failed"), *[c.alias(n) for n, c in _vector().items()]).where("not _failed")
    found = estimates(scratch, rows.drop("_failed"))
    judged = written.withColumns(_vector()).join(bounded(found), _GROUP, "left").withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(_distance() <= LIMIT, F.lit(True)))


def _group(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns with the language and the source of each row."""
    none = F.lit("\x00none")
    column = lambda c: F.coalesce(F.col(c).cast("string"), none) if c in docs.columns else none
    return docs.select(*columns, column("lang").alias("_lang"), column("source").alias("_source"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` of every row.

    Null and empty texts have zeros and fail the base limits.  A null language or
    source is a group like any other.  Rows of equal or null ids are judged each.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    plain = _group(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    written = scratch.write(with_stats(plain).drop("text"))
    return _judged(scratch, written).select("doc_id", *STATS, "base_failed", "kept")


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names."""
    scratch = Scratch(docs.sparkSession, "quality")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    written = scratch.write(with_stats(_group(docs, own, F.col(text_col).alias("text"))).drop("text"))
    return _judged(scratch, written).where("kept").select("_row.*")
