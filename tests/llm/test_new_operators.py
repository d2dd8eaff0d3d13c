"""Decontamination, k-means and whitening against brute force."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaquery.llm import decontaminate, kmeans, queries, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hits_plain(docs, items, window=10):
    """Word count, hit places and items of each document."""
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    known: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        for a in range(max(1, len(w) - window + 1)) if w else []:
            known.setdefault(tuple(w[a : a + window]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in known}:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in known:
                    hit |= set(range(a, a + n))
                    found |= known[g]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None), hit))
    return out


def digest(i, n_words, n_hit, items, _):
    return i, n_words, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_clusters"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLES[name])
    assert got.columns == [c[0] for c in want.description]
    assert rows_of(got) == Counter(want.fetchall())


def test_decontaminate(spark, docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = Counter(digest(*x) for x in hits_plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert sum(n for r, n in want.items() if r[-1])
    assert rows_of(queries.op11_decontaminate(spark, sf_dir)) == want


ITEMS = [
    (1, "a b c d e f g h i j k l"), (2, "B C d, e-f g h i j k!"), (3, "one"), (4, "One TWO"), (5, None), (6, " .,; "), (None, "it s don t"), (7, "word " * 12),
    (8, "É ß １２"), (1, "x y z"), (9, "e f g h i j k l m n o p"),
]
MORE = [
    (20, "-- a b c d e f g h i j k l m n o p -- one: TWO! 'one"), (20, "x Y z"), (21, "a b c d e f g h i b c d e f g h i j k q"), (22, "éÉ ß １２ É ß １２"),
    (23, " ".join(f"w{k}" for k in range(30_000)) + " x y z"), (24, "word " * 40_000), (25, "x" * 300_000 + " one"),
]


@pytest.fixture(scope="module")
def leaky(spark, odd):
    return odd.select("doc_id", "text", "fp", F.lit("mine").alias("n_hit"), F.lit(1).alias("_key")).unionAll(spark.createDataFrame([(i, t, "x", "mine", 1) for i, t in MORE], "doc_id long, text string, fp string, n_hit string, _key int"))


def test_decontaminate_short_items_and_odd_rows(spark, leaky):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    every = hits_plain([(r.doc_id, r.text) for r in leaky.collect()], ITEMS)
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        got = decontaminate.scan(leaky.drop("_key"), items, limit=limit)
        got = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
        assert rows_of(got) == Counter(digest(*x) for x in every)
    assert decontaminate.scan(leaky, items.where("false")).where("contaminated or n_hit <> 0 or size(items) > 0").count() == 0
    assert decontaminate.scan(leaky.where("false"), items).collect() == []


def test_decontaminated_rows_and_spans(spark, leaky):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    every = [(tuple(r), x) for r, x in zip(leaky.collect(), hits_plain([(r.doc_id, r.text) for r in leaky.collect()], ITEMS), strict=True)]
    kept = decontaminate.clean(leaky, items)
    assert kept.columns == leaky.columns
    assert rows_of(kept) == Counter(r for r, x in every if not x[2])
    want = Counter()
    for r, (_, _, n_hit, _, hit) in every:
        text = r[1]
        if n_hit:  # cut each run of hit words from its first to its last character
            found = [m.span() for m in WORD.finditer(text.translate(LOWER))]
            out, at = [], 0
            for k, (a, b) in enumerate(found):
                out += [text[at:a]] if not (k in hit and k - 1 in hit) else []
                out += [text[a:b]] if k not in hit else []
                at = b
            text = "".join([*out, text[at:]])
        want[r[:1] + (text,) + r[2:]] += 1
    got = decontaminate.clean(leaky, items, spans=True)
    assert got.columns == leaky.columns
    assert rows_of(got) == want


def clusters_plain(rows, k=8, rounds=10, width=64, seed=3):
    ok = lambda v: v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)
    points = [(i, [int(x) * 1024 if abs(x) > 2**60 else int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if ok(v)]
    key = lambda p: (p[0] is None, hashlib.sha256(f"{seed}:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1])
    centres = [v for _, v in sorted(points, key=key)[:k]]
    for r in range(rounds + 1):
        best = [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in points]
        if r < rounds:
            own = [[v for (_, v), (_, j) in zip(points, best, strict=True) if j == c] for c in range(len(centres))]
            centres = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, centres, strict=True)]
    cap = lambda x: min(x, 2**63 - 1)
    sums = [cap(sum(cap(d) for d, j in best if j == c)) for c in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    total = cap(sum(cap(d) for d, _ in best))
    return Counter((i, j, cap(d), sums[j], total, names[j]) for (i, _), (d, j) in zip(points, best, strict=True))


def test_kmeans(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert rows_of(queries.op12_clusters(spark, sf_dir)) == clusters_plain(rows)


def test_kmeans_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(300)] + [(400 + i, [1.0, 1.0, 1.0]) for i in range(200)]
    rows += [(900, None), (901, [None] * 3), (902, [float("nan")] * 3), (903, [float("inf"), 0.0, 0.0]), (904, [1.0]), (905, []), (None, [2.0, 2.0, 2.0]), (7, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    assert rows_of(kmeans.kmeans(df, k=5, rounds=6, width=3)) == clusters_plain(rows, 5, 6, 3)
    large = [(i, [x * 1e9 for x in v]) for i, v in rows[:60]] + [(950, [1e300, -1e300, 5.0]), (951, [1e18, 1.0, -7.0])]
    df = spark.createDataFrame(large, "vec_id long, embedding array<double>")
    assert rows_of(kmeans.kmeans(df, k=4, rounds=3, width=3)) == clusters_plain(large, 4, 3, 3)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert rows_of(kmeans.kmeans(few, k=8, rounds=2, width=3)) == clusters_plain(rows[:3], 8, 2, 3)
    assert kmeans.kmeans(df.where("false"), k=3, width=3).collect() == []


def test_bounds_leave_rows_out():
    """Rows far from ambiguous keep their bounds, so they weren't compared with all centroids."""
    import pyarrow as pa

    v = [[0.0, 0.0], [10.0, 0.0], [5.0, 0.0]]
    batch = pa.RecordBatch.from_pydict({"vec_id": [1, 2, 3], "v": pa.array(v, pa.list_(pa.float64())), "cluster": pa.array([0, 1, 0], pa.int32()), "upper": [5.0, 5.0, 5121.0], "lower": [10000.0, 10000.0, 5119.0]})
    out = next(kmeans.assigning([[0, 0], [10240, 0]], [1.0, 2.0], False)([batch])).to_pydict()
    assert out["cluster"] == [0, 1, 0]
    assert 6.0 < out["upper"][0] < 6.1 and 7.0 < out["upper"][1] < 7.1 and 5120 < out["upper"][2] < 5120.1
    assert 9997.9 < out["lower"][0] < 9998 and 9998.9 < out["lower"][1] < 9999


def whiten_plain(rows, keep=16):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    rows = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if ok(v)]
    x = np.array([v for _, v in rows], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s).astype(float) / n
    cov = c.T @ c / n
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)[:keep]
    w = ((n * x - s).astype(float) / n) @ vecs[:, order] / np.sqrt(values[order])
    return [i for i, _ in rows], w, ((n * x - s) ** 2).sum(1), values[order] / np.trace(cov), n


def test_whitening(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    extra = spark.createDataFrame([(-1, [0.1] * 64), (-2, [0.1] * 64), (-2, [0.1] * 64), (None, [0.2] * 64), (-3, None), (-4, [None] * 64), (-5, [float("nan")] * 64)], "vec_id long, embedding array<float>")
    every = df.select("vec_id", "embedding").unionAll(extra)
    ids, w, deviation, explained, n = whiten_plain([(r.vec_id, r.embedding) for r in every.collect()])
    got = whitening.whiten(every.withColumn("whitened", F.lit("x"))).toPandas()
    assert len(got) == 16 * len(ids) and set(got["n"]) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    by = {(None if np.isnan(i) else int(i), d): g for (i, d), g in got.groupby(["vec_id", "deviation"], dropna=False)}
    signs = None
    for i, mine, d in zip(ids, w, deviation, strict=True):
        g = by[i, int(d)].sort_values("component").drop_duplicates("component")
        assert g.component.tolist() == list(range(1, 17)) and np.allclose(g.explained, explained, rtol=1e-9)
        signs = np.sign(mine * g.whitened) if signs is None else signs
        assert np.allclose(mine * signs, g.whitened, atol=1e-7)


def test_whitening_of_few_flat_large_and_empty(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).collect() == []
    one = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.explained == 0 and r.identity_error == 0 for r in one)
    flat = whitening.whiten(make([(i, [float(i), 0.0, 3.0]) for i in range(5)])).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 5
    two = whitening.whiten(make([(i, [float(i), float(i * i % 7), -float(i)][: 2 + i % 2]) for i in range(20)]))
    assert Counter((r.vec_id % 2, r.component) for r in two.collect()) == {(0, 1): 10, (0, 2): 10, (1, 1): 10, (1, 2): 10, (1, 3): 10}
    large = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e17, 2.0])])).collect()
    assert all(r.deviation == 2**63 - 1 for r in large if r.vec_id < 3)


@pytest.mark.parametrize("n", [1, 3, 6])
def test_remainders_give_exact_numbers(n):
    mods = whitening.primes(n)
    assert all(p < 2**20 and all(p % d for d in range(2, int(p**0.5) + 1)) for p in mods) and len(set(mods)) == n
    top = int(np.prod(np.array(mods, object))) // 2
    values = np.array([[0, 1, -1, top, -top, 12345 % top]], object)
    assert whitening.remaindered([values % p for p in mods], mods).tolist() == values.tolist()


def test_scatter_is_exact_for_large_entries(spark):
    rng = np.random.default_rng(1)
    x = [[int(y) for y in row] for row in rng.integers(-(2**61), 2**61, (50, 3))]
    df = spark.createDataFrame([(v,) for v in x], "x array<long>")
    mods = whitening.needed(50 * 2**122)
    got = whitening.remaindered(whitening._summed(df.repartition(3).mapInArrow(whitening.residue_scatter(mods, 3), "part int, i int, chunk int, values array<long>"), len(mods), (4, 4), np.int64), mods)
    ones = np.array([[1, *v] for v in x], object)
    assert got.tolist() == (ones.T @ ones).tolist()
