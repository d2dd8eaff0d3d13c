"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, parquet


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from .simhash import components

    out = components(parquet(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and secrets of every document, and its redacted text as a digest."""
    from .secrets import redact, scan, train

    docs = parquet(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = scan(docs, train(docs))
    found = found.withColumns({"n_candidates": F.size("_candidates").cast("long"), "n_secrets": F.size("_secrets").cast("long"), "secrets_sha256": F.sha2(F.array_join("_secrets", "\n"), 256)})
    return redact(found).select("doc_id", "n_candidates", "n_secrets", "secrets_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("redacted_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth vector."""
    from .topk import topk

    rows = parquet(spark, sf_dir, "embeddings")
    return topk(rows.where("vec_id % 100 = 0"), rows, 10)


OP3_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.w) = len(c.w)
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from labels outside the held-out quarter."""
    from .toxicity import score

    return score(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"), remainder(4))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probabilities of every text."""
    from .lm import score

    return score(parquet(spark, sf_dir, "documents"), remainder(7))


def remainder(n: int):
    """Rows whose id's crc32 leaves 2 by n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to shard files and read back by key."""
    from . import tokenids

    directory = Scratch(spark, "tokenids").path("shards")
    manifest = tokenids.write(parquet(spark, sf_dir, "documents"), directory, tokenizer_path(), end_id=2)
    return tokenids.with_start(tokenids.read(spark, directory), manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    from .bpe import encode

    out = encode(parquet(spark, sf_dir, "documents"), tokenizer_path(), decoded=True)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its training sequence."""
    from .packing import pack_documents

    out = pack_documents(parquet(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    from .quality import judge

    return judge(parquet(spark, sf_dir, "documents"))


#: Host, path and action of the listed URLs.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    from .urls import filter_urls

    values = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, action)")
    pages = parquet(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH p AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p
), u AS (
    SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
    FROM h
), r(rhost, rpath, action) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
    SELECT page_id, rhost || rpath AS rule, action,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
    FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1
"""


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark item's windows."""
    from .decontaminate import scan

    out = scan(parquet(spark, sf_dir, "documents").select("doc_id", "text"), parquet(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP11_SQL = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS k, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), p AS (
    SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), g AS MATERIALIZED (
    SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM p
), q AS (
    SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM g) l ON len(w) >= n
), h AS MATERIALIZED (
    SELECT k, i, q.n, item FROM (SELECT k, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM q) q JOIN g ON g.gram = q.gram AND g.n = q.n
), c AS (
    SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS place FROM h) u GROUP BY k
), t AS (
    SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h WHERE item IS NOT NULL) u GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON d.k = c.k LEFT JOIN t ON d.k = t.k
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding by exact k-means."""
    from .kmeans import kmeans

    return kmeans(parquet(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, seed=3)


def _op12_sql(k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3) -> str:
    """The rounds written one after the other, each by full scans."""
    parts = [
        f"""v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS w
    FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, w FROM (SELECT sha256('{seed}:' || vec_id) AS h, w FROM v ORDER BY h LIMIT {k})
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
    SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d
    FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(v.w, c{i}.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i}) x GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
    SELECT c{i}.c, coalesce(m.w, c{i}.w) AS w FROM c{i} LEFT JOIN (
        SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS w
        FROM (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a{i}.c, unnest(w) AS x, unnest(range({width})) AS j FROM v JOIN a{i} ON v.r = a{i}.r) u GROUP BY c, j) y GROUP BY c
    ) m ON m.c = c{i}.c
)""")
    last = f"a{rounds}"
    return f"""WITH {', '.join(parts)}
SELECT v.vec_id, {last}.c AS cluster, {last}.d AS distance, CAST(sum({last}.d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia,
       CAST(sum({last}.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.w, ',')) AS centroid_sha256
FROM v JOIN {last} ON v.r = {last}.r JOIN c{rounds} ON c{rounds}.c = {last}.c"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, 16 components each."""
    from .whitening import whiten

    return whiten(parquet(spark, sf_dir, "embeddings"), components=16)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_topk": op3_topk,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_ids": op6_token_ids,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
    "op11_decontaminate": op11_decontaminate,
    "op12_clusters": op12_clusters,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op3_topk": OP3_SQL, "op9_url_filter": OP9_SQL, "op11_decontaminate": OP11_SQL, "op12_clusters": _op12_sql()}
