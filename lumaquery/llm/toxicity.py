"""Toxicity by class-conditional Kneser-Ney models.

Words are strings of bytes between two boundary symbols.  Each class, toxic and
ordinary, has a model of the next byte after up to ``ORDER`` bytes of its word;
what a class has seen is discounted and the discount goes to a backoff
distribution that both classes share, whose counts are Kneser-Ney continuation
counts over all training texts.  So an expression that one class has never seen
costs both classes the same, and one that only toxic texts use is told apart
even by its stem.

A word's evidence is its log-likelihood ratio.  A text's evidence is normalised
by its length, over the whole text and over its strongest words; a logistic
curve, fitted on labelled texts that the counts do not come from, makes it a
probability.

The models are fitted on a bounded sample of labelled rows (``max_rows`` of each
class and as many for the curve), with all their words; every text is scored whole.
The fit is a task of an executor.  The driver gets the scorer's arrays, some 12 bytes
a row, and broadcasts them once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashTable, column_texts, factorize, portions, release_memory, text_column, words_of

ORDER = 6
#: Labelled rows of each class that the counts come from, and rows for the curve.
MAX_ROWS = 4000
#: Places in words whose hashes are computed at a time.
STEP = 1_000_000
#: Words of a text whose evidence is looked at apart from the rest.
STRONGEST = (1, 3)
BLOCK = 2_000_000
PREDICTED_FROM = 0.3
_TRIM = b".,;:!?\"'()[]{}|#$%&*<>-_/\\"
_PRIME = np.uint64(0x100000001B3)


def expressions(text: str) -> list[bytes]:
    """Words without the punctuation around them; words of punctuation alone are dropped."""
    return [w for w in (x.strip(_TRIM) for x in words_of(text)) if w]


def _grams(words: list[bytes], order: int = ORDER, every: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every byte (and end) of every word: hashes of it with its 0..order
    predecessors (order + 1 columns), of those predecessors alone, whether the
    row reaches back to the word's beginning, and the word's index.  Without
    ``every`` only the column of the longest past."""
    flat = np.frombuffer(b"".join(b"\x02" + w + b"\x01" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.flatnonzero(place > 0)  # the beginning is not predicted
    gram = np.empty((order + 1 if every else 1, len(at)), np.uint64)
    context = np.empty_like(gram)
    last = (flat[at] + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    h_context = np.full(len(at), 0xCBF29CE484222325, np.uint64)
    for k in range(order + 1):
        if k:
            inside = place[at] >= k  # shorter pasts stay as they are
            h_context = np.where(inside, (h_context ^ (flat[np.maximum(at - k, 0)] + np.uint64(1))) * _PRIME + np.uint64(k), h_context)
        if every or k == order:
            to = k if every else 0
            context[to] = h_context
            x = (h_context ^ (h_context >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + last
            gram[to] = x ^ (x >> np.uint64(31))
    reach = np.minimum(place[at], order)  # the longest past there is
    return gram, context, reach, owner[at]


class Models:
    """The two class models over their shared backoff."""

    def __init__(self, order: int = ORDER):
        self.order = order

    def fit(self, words: list[bytes], counts: np.ndarray, keep: bool = False) -> Models:
        """``counts``: a row for each word, its occurrences in ordinary and in toxic texts.

        With ``keep`` the tables of the shared distribution stay, to ask for more than the words hold.
        """
        n, rows = self.order, _Places(words)
        keys, first, inv = np.unique(rows.hashes(rows.at, n)[0], return_index=True, return_inverse=True)
        owner = rows.owner[rows.at]
        weight = np.stack([np.bincount(inv, counts[owner, i]) for i in (0, 1)], axis=1)
        # a place for each distinct row of the longest past; shorter pasts are computed as they are needed
        at = rows.at[first]
        reach = np.minimum(rows.place[at], n)
        del inv, owner, first
        # shared: pooled counts for pasts that reach the word's beginning, else continuation counts
        self.shared = []
        p = np.full(len(at), 1 / 256)  # shared probability of every row, from the shortest past on
        for k in range(n):
            g, c = rows.hashes(at, k)
            longer = np.unique(rows.hashes(at, k + 1)[0], return_index=True)[1]  # a longer row fixes the shorter
            short, cont = np.unique(g[longer], return_counts=True)
            cont = cont.astype(np.float64)
            # a past at the beginning has no longer one: its pooled count stands instead
            begins = reach <= k
            if begins.any():
                bk, inv = np.unique(g[begins], return_inverse=True)
                hit = np.searchsorted(short, bk)
                cont[hit] = np.maximum(cont[hit], np.bincount(inv, weight.sum(1)[begins]))
            which = np.searchsorted(short, g)
            pair = np.zeros(len(short), np.uint64)
            pair[which] = c
            ctx, inv = np.unique(pair, return_inverse=True)
            total = np.bincount(inv, cont)
            d = _discounts(cont)
            own, spare = (cont - d) / total[inv], np.bincount(inv, d) / total
            p = own[which] + spare[inv[which]] * p
            if keep:
                self.shared.append((HashTable(short), own, HashTable(ctx), spare))
        # classes: the longest pasts
        ctx, of = np.unique(rows.hashes(at, n)[1], return_inverse=True)
        self.keys, self.contexts, self.own, self.spare = HashTable(keys), HashTable(ctx), [], []
        for c in weight.T:
            d = _discounts(c)
            total = np.bincount(of, c, minlength=len(ctx))
            safe = np.maximum(total, 1)
            self.own.append(((c - d) / safe[of]).astype(np.float32))
            self.spare.append(np.where(total > 0, np.bincount(of, d, minlength=len(ctx)) / safe, 1.0).astype(np.float32))
        self.of, self.p = of, p
        return self

    def _backoff(self, gram: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Shared probability, interpolated from the shortest past to the longest."""
        p = np.full(gram.shape[1], 1 / 256)
        for k, (keys, own, ctx, spare) in enumerate(self.shared):
            at, c = keys.find(gram[k]), ctx.find(context[k])
            p = np.where(at >= 0, own[at], 0) + np.where(c >= 0, spare[c], 1.0) * p
        return p

    def scorer(self) -> Scorer:
        """The log-likelihood ratios of all rows that some class knows.

        Where neither class has seen a byte after its past, the shared probability
        cancels and only the two discounts are left; where neither knows the past,
        the ratio is 1.  So scoring needs no backoff tables.
        """
        low, high = (self.own[i] + self.spare[i][self.of] * self.p for i in (0, 1))
        return Scorer(self.order, self.keys, _log_ratio(low, high), self.contexts, _log_ratio(self.spare[0], self.spare[1]))


def _log_ratio(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log(high) - np.log(low)
    return np.where(np.isfinite(out), out, 0.0).astype(np.float32)


_PORTION = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("content", pa.binary())])


class Scorer:
    """Log-likelihood ratios, toxic to ordinary, by rows and by pasts."""

    def __init__(self, order: int, keys: HashTable, of_key: np.ndarray, contexts: HashTable, of_context: np.ndarray):
        self.order, self.keys, self.of_key, self.contexts, self.of_context = order, keys, of_key, contexts, of_context

    def portions(self) -> Iterator[pa.RecordBatch]:
        """The arrays, ``STEP`` entries a row."""
        for i, x in enumerate((self.keys.keys, self.of_key, self.contexts.keys, self.of_context)):
            for at in range(0, len(x), STEP):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int64()), pa.array([x[at : at + STEP].tobytes()], pa.binary())], schema=_PORTION)

    @staticmethod
    def joined(order: int, table: pa.Table) -> Scorer:
        """The scorer whose ``portions`` the rows are, in any order."""
        rows = sorted(zip(*(table.column(c).to_pylist() for c in _PORTION.names), strict=True))
        parts = [np.frombuffer(b"".join(x for j, _, x in rows if j == i), kind) for i, kind in enumerate((np.uint64, np.float32) * 2)]
        return Scorer(order, HashTable(parts[0]), parts[1], HashTable(parts[2]), parts[3])

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        if not words:
            return np.zeros(0)
        gram, context, _, owner = _grams(words, self.order, every=False)
        c = self.contexts.find(context[-1])
        known = np.flatnonzero(c >= 0)
        g = self.keys.find(gram[-1][known])
        ratio = np.where(g >= 0, self.of_key[g], self.of_context[c[known]])
        return np.bincount(owner[known], ratio, minlength=len(words))


class _Places:
    """The bytes of all words in one array; the hashes that ``_grams`` gives, for chosen places and pasts."""

    def __init__(self, words: list[bytes]):
        self.flat = np.frombuffer(b"".join(b"\x02" + w + b"\x01" for w in words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int32, len(words)) + 2
        ends = np.cumsum(sizes)
        self.place = np.arange(len(self.flat), dtype=np.int32) - np.repeat(ends - sizes, sizes).astype(np.int32)
        self.owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        self.at = np.flatnonzero(self.place > 0).astype(np.int32)

    def hashes(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each place's byte with its k predecessors, and of these alone."""
        gram, context = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
        for i in range(0, len(at), STEP):
            here = at[i : i + STEP]
            h, place = np.full(len(here), 0xCBF29CE484222325, np.uint64), self.place[here]
            for j in range(1, k + 1):
                before = self.flat[np.maximum(here - j, 0)].astype(np.uint64)
                h = np.where(place >= j, (h ^ (before + np.uint64(1))) * _PRIME + np.uint64(j), h)
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (self.flat[here].astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
            gram[i : i + STEP], context[i : i + STEP] = x ^ (x >> np.uint64(31)), h
        return gram, context


def _discounts(counts: np.ndarray) -> np.ndarray:
    """What each count gives up: one amount for ones, one for twos, one for the rest."""
    n = [float((counts == i).sum()) for i in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    share = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
    one, two, more = (min(0.95 * i, max(0.3 * i, d)) for i, d in zip((1, 2, 3), share, strict=True))
    return np.select([counts <= 0, counts == 1, counts == 2], [0.0, max(one, 0.9), two], more)


def features(scorer: Scorer, texts: list[str]) -> np.ndarray:
    """For each text: mean evidence, and the mean of its strongest words."""
    per_text = [expressions(t) for t in texts]
    sizes = np.fromiter(map(len, per_text), np.int64, len(texts))
    codes, distinct = factorize([w for t in per_text for w in t])
    word = scorer.evidence(distinct)[codes]
    out = np.zeros((len(texts), 1 + len(STRONGEST)))
    for i, part in enumerate(np.split(word, np.cumsum(sizes)[:-1]) if len(texts) else ()):
        if len(part):
            out[i, 0] = part.mean()
            top = -np.sort(-np.partition(part, max(0, len(part) - max(STRONGEST)))[-max(STRONGEST) :])
            out[i, 1:] = [top[:k].mean() for k in STRONGEST]
    return out


class Curve:
    """Logistic regression on standardised features, with a small penalty."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Curve:
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = (x.std(0) if len(x) else np.ones(x.shape[1])) + 1e-9
        self.w = np.zeros(x.shape[1] + 1)
        if len(x) == 0 or y.min() == y.max():  # nothing to tell apart
            p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
            self.w[-1] = np.log(max(p, 1e-6) / (1 - min(p, 1 - 1e-6)))
            return self
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (y - p) - 0.1 * np.append(self.w[:-1], 0)
            hess = (z.T * (p * (1 - p) + 1e-9)) @ z + 0.1 * np.eye(len(self.w))
            step = np.linalg.solve(hess, grad)
            self.w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        return 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches, "text", BLOCK):
        per_text = [expressions(t) for t in column_texts(b, "text")]
        toxic = np.repeat(np.array(b.column("toxic").to_pylist(), np.int64), [len(t) for t in per_text])
        codes, distinct = factorize([w for t in per_text for w in t])
        n = [np.bincount(codes[toxic == c], minlength=len(distinct)) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.binary()), *map(pa.array, n)], names=["word", "n0", "n1"])


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scorer's portions, of the counted words of all batches; nothing without words."""
    table = pa.Table.from_batches(batches, schema=pa.schema([("word", pa.binary()), ("n0", pa.int64()), ("n1", pa.int64())]))
    if len(table):
        counts = np.stack([table.column(c).to_numpy() for c in ("n0", "n1")], axis=1)
        yield from Models().fit(table.column("word").to_pylist(), counts).scorer().portions()


def fit(docs: DataFrame, labels: DataFrame, learn_from, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Broadcast | None, Curve]:
    """The scorer, broadcast, and the curve from labelled rows where the column ``learn_from`` is true.

    Rows are drawn by the hash of their id: at most ``max_rows`` of each class for
    the counts, and as many other rows for the curve.  A document with several
    labels is toxic if one of them says so; of repeated ids one text counts.
    Without labels every score is the same.
    """
    spark = docs.sparkSession
    key = F.col("doc_id")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(learn_from & key.isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("part", F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) < 2, F.col("toxic")).otherwise(2))
    picked = [known.where(F.col("part") == p).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for p in (0, 1, 2)]
    chosen = picked[0].unionAll(picked[1]).unionAll(picked[2])  # 3 * max_rows rows at most
    texts = docs.select(key_of(docs, id_col), text_column(docs, text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text"))
    from .common import Scratch

    rows = Scratch(spark, "toxicity").write(rows)
    counted = rows.where("part < 2").select("text", "toxic").mapInArrow(_counted, "word binary, n0 long, n1 long")
    counted = counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # one task sees the words of 2 * max_rows texts at most
    table = counted.repartition(1).mapInArrow(_learnt, "part int, place long, content binary").toArrow()
    scorer = spark.sparkContext.broadcast(Scorer.joined(ORDER, table)) if len(table) else None
    del table
    release_memory()
    rest = rows.where("part = 2").select("doc_id", "text", "toxic")
    seen = annotate(rest, scorer, None, raw=True).select("toxic", "_features").collect()
    curve = Curve().fit(np.array([r[1] for r in seen]).reshape(-1, 1 + len(STRONGEST)), np.array([r[0] for r in seen], float))
    return scorer, curve


def key_of(docs: DataFrame, id_col: str):
    return F.col(id_col).cast("long").alias("doc_id")


def _sent(spark: SparkSession, scorer: Broadcast | Scorer | None) -> Broadcast:
    """The scorer for tasks; one that is broadcast already is not sent again."""
    return scorer if isinstance(scorer, Broadcast) else spark.sparkContext.broadcast(scorer)


def annotate(docs: DataFrame, scorer: Broadcast | Scorer | None, curve: Curve | None, text_col: str = "text", raw: bool = False) -> DataFrame:
    """``docs`` with ``_toxicity`` (0 to 1) of every row, null and empty texts too;
    with ``raw`` the features instead, as ``_features``.  A column of that name is replaced;
    ``ordinary`` keeps all columns."""
    shared = _sent(docs.sparkSession, scorer)
    name = "_features" if raw else "_toxicity"
    plain = docs.drop(name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for b in portions(batches, text_col, BLOCK):
            x = features(scorer, column_texts(b, text_col)) if scorer else np.zeros((b.num_rows, 1 + len(STRONGEST)))
            out = pa.array(x.tolist(), pa.list_(pa.float64())) if raw else pa.array(curve(x))
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(work, f"{fields}, {name} {'array<double>' if raw else 'double'}")


def ordinary(docs: DataFrame, scorer: Broadcast | Scorer | None, curve: Curve, below: float = PREDICTED_FROM, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score under ``below``, with their own columns, whatever their names."""
    shared = _sent(docs.sparkSession, scorer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for b in portions(batches, text_col, BLOCK):
            x = features(scorer, column_texts(b, text_col)) if scorer else np.zeros((b.num_rows, 1 + len(STRONGEST)))
            yield b.filter(pa.array(curve(x) < below))

    return docs.mapInArrow(work, docs.schema)


def score(docs: DataFrame, labels: DataFrame, held_out, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    ``held_out``: a boolean column over ``doc_id``; such rows' labels are not used.
    A null id is not held out.  Equal texts have equal scores.
    """
    held = F.coalesce(held_out, F.lit(False))
    scorer, curve = fit(docs, labels, ~held, **options)
    rows = docs.select(key_of(docs, options.get("id_col", "doc_id")), text_column(docs, options.get("text_col", "text")).alias("text"))
    out = annotate(rows, scorer, curve)
    return out.select("doc_id", held.alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= PREDICTED_FROM).cast("int").alias("predicted"))
