"""Stratified folds of subjects by greedy assignment, and all partitions of few subjects into groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scale of a label's weight, one over the square of its rows.
SCALE = 10**18


def turns(x: list[int], n: int, weight: list[int], sums: list[list[int]], rows: list[int]) -> tuple[list[int], list[int]]:
    """Folds of n subjects of the same label counts: the first ones', and those that take turns from then on.

    A subject goes where the weighted product of the fold's counts with its own is least, which
    adds least to the sum of squared shares; then to the fold of fewer rows, then to the first.
    Each subject raises its fold's product and rows by the same step, so as soon as the lowest
    fold with a step more is past the highest, the folds follow each other in their order.  The
    folds' counts and rows are raised.  Whole numbers throughout.
    """
    own = [(j, c, c * w) for j, (c, w) in enumerate(zip(x, weight, strict=True)) if c]
    cost, size = sum(c * cw for _, c, cw in own), sum(c for _, c, _ in own)
    state = [(sum(h[j] * cw for j, _, cw in own), r, f) for f, (h, r) in enumerate(zip(sums, rows, strict=True))]
    first, more = [], [0] * len(sums)
    while len(first) < n:
        low = min(state)
        if (low[0] + cost, low[1] + size, low[2]) > max(state):
            break
        first.append(low[2])
        more[low[2]] += 1
        state[low[2]] = (low[0] + cost, low[1] + size, low[2])
    cycle = [f for _, _, f in sorted(state)]
    times, rest = divmod(n - len(first), len(cycle))
    for i, f in enumerate(cycle):
        more[f] += times + (i < rest)
        for j, c, _ in own:
            sums[f][j] += c * more[f]
        rows[f] += size * more[f]
    return first, cycle


def _assigned(keys: list[str], k: int):
    """A task's runs in order, with their folds; only the folds' counts are kept from run to run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, rows = None, [], []
        for b in batches:
            out = []
            for *key, x, w, n in zip(*[b.column(c).to_pylist() for c in [*keys, "_x", "_w", "_n"]]):
                if at is None or key != at:
                    at, sums, rows = key, [[0] * len(x) for _ in range(k)], [0] * k
                out.append(turns(x, n, w, sums, rows))
            kept = [*keys, "_spread", "_run"]
            made = [pa.array([r[i] for r in out], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *made], names=[*kept, "_first", "_cycle"])

    return work


def counted(df: DataFrame, subject: str, label: str, keys: list[str]) -> tuple[DataFrame, list]:
    """A row for each subject with its counts of every label, and the labels (a null label is one too)."""
    labels = sorted((r[0] for r in df.select(label).distinct().collect()), key=lambda x: (x is None, str(x)))
    each = [F.count_if(F.col(label).eqNullSafe(F.lit(x))) for x in labels]
    return df.groupBy(*keys, subject).agg(F.array(*each).alias("_x")), labels


def group_folds(df: DataFrame, subject: str, label: str, k: int, keys: list[str] | None = None, lot: int | None = None) -> DataFrame:
    """(keys, subject, fold): subjects in k folds of shares of every label that are as even as a greedy order makes them.

    Subjects go in order of falling spread (weighted squares of their counts, then by name as text).
    No subject is in two folds.  ``keys`` (few values) name tables with folds of their own.  The order is
    one after the other by nature, but subjects of the same counts that follow each other need one
    step together (``turns``): a row a run goes through a key's task, and each subject finds its fold by its
    place in the run.  ``lot`` is without effect: no order is cut into lots any more.
    """
    keys = keys or []
    counts, labels = counted(df, subject, label, keys)
    totals = [F.sum(F.get("_x", F.lit(j))).cast("decimal(19,0)") for j in range(len(labels))]
    each = [F.when(t > 0, F.call_function("div", F.lit(SCALE).cast("decimal(38,0)"), t * t)).otherwise(F.lit(0).cast("long")) for t in totals]
    weight = counts.groupBy(*keys).agg(F.array(*each).cast("array<bigint>").alias("_w")).select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_w")
    same = lambda d: [d[c].eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    placed = counts.join(F.broadcast(weight), same(counts) or None, "inner" if keys else "cross").drop(*[f"_k_{c}" for c in keys])  # a row a key
    wide = lambda c: c.cast("decimal(19,0)")
    squares = F.zip_with("_x", "_w", lambda x, w: (wide(x) * wide(x) * wide(w)).cast("decimal(38,0)"))
    placed = placed.withColumn("_spread", F.aggregate(squares, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)")))
    # a run: subjects of equal counts that follow each other; other counts have the same spread only in ties
    order = Window.partitionBy(*keys, "_spread").orderBy(F.col(subject).cast("string").asc_nulls_last())
    placed = placed.withColumn("_r", F.row_number().over(order)).withColumn("_new", F.coalesce(F.lag("_x").over(order) != F.col("_x"), F.lit(True)))
    placed = placed.withColumn("_run", F.max(F.when(F.col("_new"), F.col("_r"))).over(order)).withColumn("_at", F.col("_r") - F.col("_run"))
    runs = placed.groupBy(*keys, "_spread", "_run").agg(F.any_value("_x").alias("_x"), F.any_value("_w").alias("_w"), F.count("*").alias("_n"))
    dealt = runs.repartition(*keys) if keys else runs.repartition(1)
    kinds = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys], "_spread decimal(38,0), _run int, _first array<int>, _cycle array<int>"])
    folds = dealt.sortWithinPartitions(*keys, F.desc("_spread"), "_run").mapInArrow(_assigned(keys, k), kinds)
    folds = folds.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_spread").alias("_k_spread"), F.col("_run").alias("_k_run"), "_first", "_cycle")
    out = placed.join(folds, [*same(placed), placed["_spread"] == F.col("_k_spread"), placed["_run"] == F.col("_k_run")])
    early = F.col("_at") < F.size("_first")
    fold = F.when(early, F.get("_first", F.col("_at"))).otherwise(F.get("_cycle", F.pmod(F.col("_at") - F.size("_first"), F.lit(k))))
    return out.select(*keys, subject, fold.alias("fold"))


def unevenness(df: DataFrame, folds: DataFrame, subject: str, label: str, k: int) -> DataFrame:
    """``spread``: over the labels, the mean standard deviation of the folds' shares of a label's rows."""
    n = df.join(folds, subject).groupBy(label, "fold").agg(F.count("*").alias("_n"))
    total = n.groupBy(label).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.col("_n")).alias("_q"))
    # folds without a row of the label count as zero
    deviation = F.sqrt(F.col("_q") / (F.col("_t") * F.col("_t")) / k - F.lit(1.0 / k) ** 2)
    return total.agg(F.avg(deviation).alias("spread"))


def nested_group_folds(df: DataFrame, subject: str, label: str, outer: int, inner: int) -> DataFrame:
    """(subject, outer_fold, fold, split): greedy folds, and within each one's training subjects greedy folds of their own."""
    held = group_folds(df, subject, label, outer).withColumnRenamed("fold", "_own")
    rows = df.select(subject, label).join(held, subject).withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    within = group_folds(rows.where(F.col("_own") != F.col("outer_fold")), subject, label, inner, ["outer_fold"])
    test = held.select(subject, F.col("_own").alias("outer_fold"), F.lit(None).cast("int").alias("_in"))
    every = within.select(subject, "outer_fold", F.col("fold").alias("_in")).unionAll(test)
    every = every.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
    return every.select(subject, "outer_fold", "fold", F.when(F.col("_in").isNull(), "test").when(F.col("_in") == F.col("fold"), "val").otherwise("train").alias("split"))


def fold_partitions(subjects: DataFrame, subject: str, labels: str, size: int = 3, least: int = 0) -> DataFrame:
    """``groups`` (arrays of ``size`` subjects) and ``n_labels`` of every way to part the subjects into groups.

    The first free subject opens each group, so no way comes twice.  A way stays if its groups' numbers
    of different labels add up to ``least`` or more; ``labels`` is a column of arrays.  Subjects and
    labels are bits of a number, so there may be 62 of each.  A recursive query: every step adds a
    group to all ways at once, dealt over the tasks; Spark's limit of rows
    (spark.sql.cteRecursionRowLimit) holds.  A number of subjects that ``size`` doesn't
    divide has no way; so has an empty table.
    """
    spark = subjects.sparkSession
    one = F.lit(1).cast("long")
    bit = lambda c: F.call_function("shiftleft", one, (c - 1).cast("int"))
    known = subjects.select(F.explode(labels).alias("x")).distinct().agg(F.sort_array(F.collect_list("x")).alias("_all"))
    rows = subjects.agg(F.sort_array(F.collect_list(F.struct(F.col(subject).alias("s"), F.col(labels).alias("l")))).alias("_rows"))  # at most 62 of them
    rows = rows.select(F.posexplode("_rows").alias("p", "r"), F.size("_rows").alias("n")).crossJoin(F.broadcast(known))
    mask = F.aggregate(F.array_distinct(F.coalesce("r.l", F.array().cast(subjects.schema[labels].dataType))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(F.array_position("_all", x).cast("int"))))
    table = rows.where(f"n % {size} = 0 and n <= 62").select("p", "n", F.col("r.s").alias("s"), bit(F.col("p") + 1).alias("bit"), mask.alias("labels"))
    # a group: the first free subject and size - 1 later free ones in rising order
    joins = "".join(f" JOIN fold_subjects s{i} ON s{i}.p > s{i - 1}.p AND (w.used & s{i}.bit) = 0" for i in range(1, size))
    names = ", ".join(f"s{i}.s" for i in range(size))
    bits, marks = " | ".join(f"s{i}.bit" for i in range(size)), " | ".join(f"s{i}.labels" for i in range(size))
    query = f"""
        WITH RECURSIVE ways(step, n, used, groups, n_labels) MAX RECURSION LEVEL 64 AS (
            SELECT 0, max(n), CAST(0 AS BIGINT), CAST(array() AS ARRAY<ARRAY<{subjects.schema[subject].dataType.simpleString()}>>), 0 FROM fold_subjects HAVING max(n) IS NOT NULL
            UNION ALL
            SELECT w.step + 1, w.n, w.used | {bits}, array_append(w.groups, array({names})), w.n_labels + CAST(bit_count({marks}) AS INT)
            FROM ways w JOIN fold_subjects s0 ON (w.used & s0.bit) = 0 AND (w.used & (s0.bit - 1)) = s0.bit - 1{joins}
        )
        SELECT groups, n_labels FROM ways WHERE step * {size} = n AND n_labels >= {least}"""
    table.createOrReplaceTempView("fold_subjects")
    try:
        return spark.sql(query)
    finally:
        spark.catalog.dropTempView("fold_subjects")
