"""Near duplicates by shingle similarity of at least a threshold, part of the SimHash operator.

A document is the set of its five-word shingles.  Documents of equal sets are one
class.  Classes whose SimHash fingerprints meet in a covering table (3 bits or fewer
apart) are candidates.  As few pairs of similarity 0.8 are that near, classes that
agree in a band of a MinHash signature are candidates too: with 32 bands of 6
values a pair of similarity 0.8 is missed with probability (1 - 0.8 ** 6) ** 32,
which is 6e-5.  Candidates count only after their sets have been compared whole.

Candidates that hang together are compared in groups of bounded size, two chunks
at a time.  In a group the smallest id leads: what is similar to it is linked to
it and is done, the rest goes on with its next smallest id.  So two documents
that both stay have been compared with each other, and a large group of near
copies costs one comparison a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import Scratch, hash_words, mix, text_column, words_of
from .components import connected_components

WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_VALUES = 32, 6
#: Classes of a chunk.
CHUNK = 512
#: Shingles whose MinHash values are computed at a time.
STEP = 2048

_RNG = np.random.default_rng(11)
_A = _RNG.integers(0, 1 << 63, BANDS * BAND_VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * BAND_VALUES, np.uint64)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of a text's word shingles, repeats included; a shorter text is one shingle."""
    h = hash_words(words_of(text))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n if len(h) else 0, np.uint64)
    for k in range(min(words, len(h))):
        out = mix(out, h[k : k + n])
    return out


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, words))


def band_keys(sets: np.ndarray) -> np.ndarray:
    """A key for each band of a set's signature; none for the empty set."""
    if not len(sets):
        return np.zeros(0, np.uint64)
    low = np.full(len(_A), np.uint64(2**64 - 1))
    for k in range(0, len(sets), STEP):
        np.minimum(low, (sets[None, k : k + STEP] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for values in low.reshape(BANDS, BAND_VALUES).T:
        key = mix(key, values)
    return key


def digest(sets: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(sets.tobytes(), 42)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        every = [shingle_hashes(t or "") for t in b.column("text").to_pylist()]
        fps = np.array([simhash.of_hashes(h) for h in every], np.uint64).view(np.int64)
        sets = list(map(np.unique, every))
        nodes = np.array([digest(s) for s in sets], np.uint64).view(np.int64)
        keys = [band_keys(s).view(np.int64) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(nodes), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "fp", "keys"])


def _nodes(text_col: str):
    """Rows with the class of their text in a last column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = np.array([digest(shingles(t or "")) for t in b.column(text_col).cast(pa.string()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes)], names=[*b.schema.names, "_node"])

    return work


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t or "") for t in b.column("text").to_pylist()]
        same = np.array([digest(s) for s in sets], np.uint64).view(np.int64) == b.column("node").to_numpy()
        keep = pa.array(same)  # another text of the same id is another class
        out = [b.column(c).filter(keep) for c in ("node", "first", "component", "k")]
        yield pa.RecordBatch.from_arrays([*out, pa.array([s.tobytes() for s, x in zip(sets, same, strict=True) if x], pa.binary())], names=["node", "first", "component", "k", "shingles"])


def leaders(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the first one that leads and is similar to it; a leader has itself."""
    lead, left = np.full(len(sets), -1), np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    while len(left):
        at, left = left[0], left[1:]
        lead[at] = at
        left_sizes = sizes[left]
        # sets of too different sizes can't be similar
        near = left[(np.minimum(left_sizes, sizes[at]) >= similarity * np.maximum(left_sizes, sizes[at]))]
        if len(near):
            owner = np.repeat(np.arange(len(near)), sizes[near])
            values = np.concatenate([sets[x] for x in near])
            place = np.minimum(np.searchsorted(sets[at], values), max(0, sizes[at] - 1))
            hit = sets[at][place] == values if sizes[at] else np.zeros(0, bool)
            shared = np.bincount(owner[hit], minlength=len(near))
            lead[near[shared >= similarity * (sizes[near] + sizes[at] - shared)]] = at
            left = left[lead[left] < 0]
    return lead


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and first id become (node, leader) for nodes similar to a leader."""
    group, nodes, sets = None, [], []

    def close() -> pa.RecordBatch:
        lead = leaders(sets)
        linked = [(nodes[x], nodes[y]) for x, y in enumerate(lead.tolist()) if nodes[x] != nodes[y]]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    for b in batches:
        for g, node, s in zip(b.column("group").to_pylist(), b.column("node").to_pylist(), b.column("shingles"), strict=True):
            if g != group and nodes:
                yield close()
                nodes, sets = [], []
            group = g
            nodes.append(node)
            sets.append(np.frombuffer(s.as_py(), np.uint64))
    if nodes:
        yield close()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of what is linked that of the smallest id.

    Rows of the same id count as one document, of which the row of the smallest text
    stays.  Rows without an id are compared by their whole shingle sets only: of those
    with equal sets the one of the smallest text stays, and none if a row with an id
    has that set.  Null and empty texts are one class.
    """
    found, classes = _kept(docs, id_col, text_col, chunk)
    # the row as one value, so that names of its columns can't clash
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    text = F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit(""))
    place = F.struct(text, F.xxhash64(*[f"_row.`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]))
    first = F.min_by("_row", place).alias("_row")
    known = rows.where("_id is not null").join(found.withColumnRenamed("doc_id", "_id"), "_id", "left_semi").groupBy("_id").agg(first)
    loose = rows.where("_id is null").select("_row", text.alias("_text"))
    loose = loose.mapInArrow(_nodes("_text"), T.StructType([*loose.schema.fields, T.StructField("_node", T.LongType())]))
    loose = loose.join(classes.select(F.col("node").alias("_node")), "_node", "left_anti").groupBy("_node").agg(first)
    return known.select("_row.*").unionAll(loose.select("_row.*"))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id`` of the documents that stay: the smallest id of what is linked.

    Rows without an id are left out; rows of the same id count as one document.
    """
    return _kept(docs, id_col, text_col, chunk)[0]


def _kept(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Ids that stay, and the classes of all rows with an id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    rows = scratch.write(texts.mapInArrow(_signatures, "doc_id long, node long, fp long, keys array<long>"))
    classes = scratch.write(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))

    # candidates: equal or near fingerprints, and equal bands
    same = scratch.write(classes.groupBy("fp").agg(F.min("node").alias("node")))
    equal = classes.join(same.withColumnRenamed("node", "dst"), "fp").where("node <> dst").select(F.col("node").alias("src"), "dst")
    near = simhash.links(scratch, same)
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = scratch.write(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
    banded = keyed.join(shared, "key").where("node <> hub").select(F.col("node").alias("src"), F.col("hub").alias("dst"))
    # a class meets at most a hub a band; its hubs are linked to the smallest of them, and it to that one,
    # so that a large group of near copies gives a link a class and few between hubs
    stars = banded.unionAll(equal).groupBy("src").agg(F.min("dst").alias("least"), F.collect_set("dst").alias("hubs"))
    stars = scratch.write(stars)
    between = stars.select(F.explode("hubs").alias("src"), F.col("least").alias("dst")).where("src <> dst")
    met = scratch.write(between.unionAll(stars.select("src", F.col("least").alias("dst"))).unionAll(near).distinct())
    together = scratch.write(connected_components(spark, scratch, met))

    sizes = together.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("k"))
    members = scratch.write(together.join(sizes, "component").join(classes.select("node", "first"), "node").select("node", "first", "component", "k"))
    sets = texts.join(members.withColumn("doc_id", F.col("first")), "doc_id").select("node", "first", "component", "k", "text").mapInArrow(_sets, "node long, first long, component long, k int, shingles binary")
    own = sets.withColumn("c", F.pmod(F.xxhash64("node"), "k").cast("int"))
    pairs = own.select("component", "node", "first", "c", "shingles", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    grouped = pairs.select(F.xxhash64("component", F.least("c", "o"), F.greatest("c", "o")).alias("group"), "first", "node", "shingles")
    dealt = grouped.repartition(parts, "group").sortWithinPartitions("group", "first")
    links = dealt.mapInArrow(_link, "src long, dst long")

    several = rows.groupBy("doc_id").agg(F.min("node").alias("dst"), F.max("node").alias("most")).where("dst <> most").select("doc_id", "dst")
    links = scratch.write(links.unionAll(rows.join(several, "doc_id").select(F.col("node").alias("src"), "dst")).distinct())
    found = connected_components(spark, scratch, links)
    whole = classes.select("node", "first").join(found, "node", "left").select(F.coalesce("component", "node").alias("c"), "first")
    return scratch.write(whole.groupBy("c").agg(F.min("first").alias("doc_id")).select("doc_id")), classes
