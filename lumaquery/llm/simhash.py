"""Near duplicates by SimHash and covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint.  Fingerprints that differ in at most
``radius`` bits are linked; a document's component is what it reaches by links.

With radius 3, each bit position is given a non-zero vector of 4 bits.  Each of
the 15 non-zero vectors v makes a mask: the positions whose vector has an odd
inner product with v.  The vectors of up to 3 differing positions leave some v
orthogonal to all of them, so the two fingerprints agree under that mask: every
pair within the radius meets in some table, without exception.

Documents of equal fingerprints are one class from the start, so copies cost
nothing further.  In a table's bucket the classes are compared in chunks of
bounded size (each pair of chunks is a group of its own), and a group gives only
a spanning forest of its links, never all pairs.

``components`` links by fingerprints alone.  ``deduplicate`` keeps one document of
each group whose five-word shingles are at least 0.8 similar.  There fingerprints
alone would find little, as a pair of similarity 0.8 differs in about 10 bits: the
covering tables give one kind of candidates, MinHash bands the others, and all are
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_column, words_of
from .components import connected_components, forest

RADIUS = 3
WORDS = 3
#: Classes of a bucket that are compared with those of another chunk at a time.
CHUNK = 1024

_PLACES = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks for 64 bits, as signed 64-bit numbers."""
    full = (1 << (radius + 1)) - 1
    vectors = [i % full + 1 for i in range(64)]
    out = []
    for v in range(1, full + 1):
        mask = sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of a text's word shingles; a bit is 1 if it is set in over half of them."""
    w = words_of(text)
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(w) - words + 1
    return of_hashes(np.fromiter((digest(join(w[i : i + words]), 42) for i in range(n)), np.uint64, n))


def of_hashes(h: np.ndarray) -> int:
    """SimHash of the 64-bit hashes of a text's shingles, zero without any."""
    n = len(h)
    if not n:
        return 0
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row.

    Null and empty texts, and those of white space, have fingerprint zero.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or "") for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, fp long")


def _link(radius: int):
    """Rows sorted by group and node become (node, root) for nodes linked in their group."""

    def close(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        group = rows["group"]
        n = len(group)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
        fp, at, pairs = rows["fp"].view(np.uint64), np.arange(n), []
        d = 1
        while len(at := at[at + d < end[at]]):
            near = np.bitwise_count(fp[at] ^ fp[at + d]) <= radius
            pairs.append((at[near], at[near] + d))
            d += 1
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        root = forest(n, a, b)
        linked = root != np.arange(n)
        node = rows["node"]
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["src", "dst"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            new = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("group", "node", "fp")}
            rows = {k: np.concatenate([held[k], v]) for k, v in new.items()} if held else new
            if not len(rows["group"]):
                continue
            cut = int(np.flatnonzero(np.append(True, rows["group"][1:] != rows["group"][:-1]))[-1])
            held = {k: v[cut:] for k, v in rows.items()}  # the last group may go on
            if cut:
                yield close({k: v[:cut] for k, v in rows.items()})
        if held:
            yield close(held)

    return work


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included.
    Rows with a null id get their fingerprint; their component is that of the
    equal fingerprint, null if no row with an id has it, and they link nothing else.
    Rows of the same id count as one document.  Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.write(fingerprints(docs, id_col, text_col))
    classes = scratch.write(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found_links = scratch.write(links(scratch, classes, radius, chunk))
    # two fingerprints of one id are linked through it
    found = connected_components(spark, scratch, found_links)
    whole = scratch.write(classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return fps.join(whole, "fp", "left").select("doc_id", "fp", "component_id")


def links(scratch: Scratch, classes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links that join the fingerprint classes of every bucket, as (src, dst) ids."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks(radius))])
    keyed = classes.select("fp", "node", F.explode(tables).alias("x")).select("fp", "node", "x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    sizes = scratch.write(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), "k").cast("int")
    members = keyed.join(sizes, ["t", "key"]).withColumn("k", parts).withColumn("c", own)
    pairs = members.select("t", "key", "fp", "node", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    grouped = pairs.select(F.xxhash64("t", "key", F.least("c", "o"), F.greatest("c", "o")).alias("group"), "fp", "node")
    dealt = grouped.repartition(_partitions(scratch.spark), "group").sortWithinPartitions("group", "node")
    return dealt.mapInArrow(_link(radius), "src long, dst long").distinct()


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are similar to another that stays; see ``similar.deduplicate``."""
    from .similar import deduplicate as work

    return work(docs, id_col, text_col)
