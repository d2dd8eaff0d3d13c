"""Token ids in binary shard files with keyed access.

Documents are sorted by id over the cluster (range partitioning) and every task
writes its range as shard files of bounded size.  A file holds

    magic, header length, JSON header, then the arrays the header names:
    bounds    n + 1 positions in the payload
    keys      the n document ids (and whether each is null)
    levels, fingerprints, ordinals
              the minimal perfect hash of the keys: key -> slot -> first document
    ids       raw payload, unsigned 16 bits where the vocabulary allows, else 32

so one document is found in constant time without a search; the fingerprint turns
most absent keys away and the stored key is compared as well.  Files are written
under a passing name and then moved, so a task that is run again replaces its
files by the same ones.  A manifest (Parquet) lists the shards in order with the
first and last key of each, so that ``fetch`` reads only the shards that may hold
what is asked for, and of these the index and the byte ranges of the documents.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytelevel import BLOCK_CHARS, library_encoder, vocabulary
from .common import column_texts, portions, text_column
from .mph import PerfectHash

MAGIC = b"TOKSHRD2"
#: Ids after which a task begins another shard file.
SHARD_IDS = 4_000_000
#: Shards of a group; ``fetch`` broadcasts one key a group (8 bytes for 256 million ids).
GROUP = 64
#: Tasks whose shards are summed up together for the places in the whole order.
BLOCK = 1000
MANIFEST = "task int, seq int, file string, docs long, ids long, first long, last long"


def pack_shard(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One shard file from documents in order; repeated keys follow one another."""
    null = np.array([k is None for k in keys], bool)
    numbers = np.array([0 if k is None else k for k in keys], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.uint64)
    known = np.flatnonzero(~null)
    distinct, first = np.unique(numbers[known], return_index=True)
    mph = PerfectHash.build(distinct)
    ordinals = np.zeros(len(distinct), np.uint32)
    ordinals[mph.find(distinct)] = known[first]
    parts = {
        "bounds": bounds,
        "keys": numbers,
        "null": np.packbits(null),
        "fingerprints": mph.fingerprints,
        "ordinals": ordinals,
    } | {f"level{i}": np.packbits(x) for i, x in enumerate(mph.levels)}
    parts["ids"] = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(f"<u{width}")
    layout, at = {}, 0
    for name, a in parts.items():
        layout[name] = [a.dtype.str, at, len(a)]
        at += a.nbytes + -a.nbytes % 8
    header = json.dumps({"docs": len(keys), "levels": [len(x) for x in mph.levels], "layout": layout}).encode()
    header += b" " * (-(len(header) + 16) % 8)
    body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in parts.values())
    return MAGIC + len(header).to_bytes(8, "little") + header + body


class Shard:
    """A shard file; ``get`` is the keyed access.

    ``source``: the whole content, or an open file, of which only the index is read at first.
    """

    def __init__(self, source: bytes | pa.NativeFile):
        self.source = source
        if self._raw(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(self._raw(8, 8), "little")
        header = json.loads(self._raw(16, size))
        kind, payload, self.n_ids = header["layout"]["ids"]
        self.kind, self.payload = np.dtype(kind), 16 + size + payload
        index = self._raw(16 + size, payload)
        part = lambda name: np.frombuffer(index, *((lambda d, at, n: (d, n, at))(*header["layout"][name])))
        self.bounds, self.keys = part("bounds").astype(np.int64), part("keys")
        self.null = np.unpackbits(part("null"), count=header["docs"]).astype(bool)
        levels = [np.unpackbits(part(f"level{i}"), count=n).astype(bool) for i, n in enumerate(header["levels"])]
        self.mph, self.ordinals = PerfectHash(levels, part("fingerprints")), part("ordinals")

    def _raw(self, at: int, size: int) -> bytes:
        return self.source[at : at + size] if isinstance(self.source, bytes) else self.source.read_at(size, at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first document of each key, -1 if there is none."""
        keys = np.asarray(keys, np.int64)
        slot = self.mph.find(keys)
        if not len(self.ordinals):
            return slot
        at = np.where(slot >= 0, self.ordinals[slot].astype(np.int64), -1)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1)  # another key may have the fingerprint

    def document(self, ordinal: int) -> np.ndarray:
        begin, end = (int(x) for x in self.bounds[ordinal : ordinal + 2])
        width = self.kind.itemsize
        return np.frombuffer(self._raw(self.payload + begin * width, (end - begin) * width), self.kind)

    def get(self, key: int) -> np.ndarray | None:
        at = int(self.find(np.array([key]))[0])
        return None if at < 0 else self.document(at)


def write(docs: DataFrame, directory: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` with the tokenizers library into shard files; the manifest.

    Order: id (null first), then a hash of the text, so that rows of one id or none
    are spread over tasks too, then text.  ``end_id`` follows every document.  A
    null text is empty; repeated ids stay as documents of their own, of which
    keyed access gives the first.  An empty table gives an empty manifest.
    ``directory`` must be one that driver and executors share.
    """
    spark = docs.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seq = library_encoder(path), TaskContext.get().partitionId(), 0
        width = 2 if vocabulary(path).size <= 65536 and (end_id or 0) < 65536 else 4
        store, at = fs.FileSystem.from_uri(directory)
        keys, ids, held = [], [], 0
        tail = [end_id] if end_id is not None else []

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, seq
            name = f"shard-{task:06d}-{seq:06d}.ids"
            passing = f"{at}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(passing) as out:
                out.write(pack_shard(keys, ids, width))
            store.move(passing, f"{at}/{name}")
            some = [k for k in keys if k is not None]
            row = [[task], [seq], [name], [len(keys)], [held], [min(some, default=None)], [max(some, default=None)]]
            keys, ids, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], names=["task", "seq", "file", "docs", "ids", "first", "last"])

        for b in portions(batches, "text", 2 * BLOCK_CHARS):
            for key, found in zip(b.column("doc_id").to_pylist(), enc.encode(column_texts(b, "text")), strict=True):
                keys.append(key)
                ids.append(np.append(found, np.array(tail, np.uint32)).astype(np.uint16 if width == 2 else np.uint32))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    store, at = fs.FileSystem.from_uri(directory)
    store.create_dir(at, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(work, MANIFEST).write.parquet(f"{directory}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{directory}/manifest")


def read(spark: SparkSession, directory: str) -> DataFrame:
    """Every document of the shard files, found by its key: ``doc_id``, ``file``,
    ``ordinal``, ``n_tokens`` and ``ids_crc32`` (of 32-bit ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                s = Shard(content.as_py())
                n = len(s.keys)
                # a repeated or null key has no place of its own in the index: its place in the file counts
                first = np.where(s.null, np.arange(n), s.find(s.keys))
                if (first < 0).any():
                    raise ValueError(f"{path}: keys missing from the index")
                again = np.append(False, (s.keys[1:] == s.keys[:-1]) & (s.null[1:] == s.null[:-1])) if n else np.zeros(0, bool)
                place = np.where(again, np.arange(n), first)
                sizes = np.diff(s.bounds)[place]
                crc = [zlib.crc32(s.document(i).astype("<u4").tobytes()) for i in place.tolist()]
                cols = [pa.array(s.keys, mask=s.null), pa.array([path.rsplit("/", 1)[-1]] * n, pa.string()), pa.array(place), pa.array(sizes), pa.array(s.bounds[place]), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "file", "ordinal", "n_tokens", "begin", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(directory).select("path", "content")
    return files.mapInArrow(work, "doc_id long, file string, ordinal long, n_tokens long, begin long, ids_crc32 long")


def _numbered(manifest: DataFrame, value) -> DataFrame:
    """The manifest with ``before``: the sum of ``value`` over all shards before each.

    Sums go over blocks of tasks first and then within a block.
    """
    upto = lambda w: F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = manifest.withColumn("_v", value).withColumn("_block", F.floor(F.col("task") / BLOCK))
    blocks = rows.groupBy("_block").agg(F.sum("_v").alias("_v"))
    blocks = blocks.select("_block", upto(Window.orderBy("_block")).alias("_blocks"))  # a row for each thousand tasks
    rows = rows.withColumn("_within", upto(Window.partitionBy("_block").orderBy("task", "seq"))).join(blocks, "_block")
    return rows.withColumn("before", F.col("_blocks") + F.col("_within")).drop("_v", "_block", "_blocks", "_within")


def with_start(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids before each document in the whole order."""
    starts = _numbered(manifest, F.col("ids")).select("file", "before")
    return documents.join(starts, "file").withColumn("start", F.col("before") + F.col("begin"))


def fetch(spark: SparkSession, directory: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents whose keys are asked for: ``doc_id`` and ``ids`` (binary, 32 bits).

    Any number of keys; each is answered once, with its first document, and not at all
    if no document has it.  Keys are brought to the shards whose range holds them: a
    key's group of shards is found by the groups' first keys, its shard by a join with
    the group.  A shard's task reads the index and the byte ranges asked for.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{directory}/manifest").where("first is not null")
    grouped = _numbered(manifest, F.lit(1)).withColumn("group", F.floor(F.col("before") / GROUP))
    heads = np.array([r["first"] for r in grouped.groupBy("group").agg(F.min("first").alias("first")).orderBy("group").collect()], np.int64)
    shared = spark.sparkContext.broadcast(heads)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            # a key that opens a group may also close groups before it: the first that holds it counts
            to = np.searchsorted(shared.value, key, "left") - 1
            end = np.searchsorted(shared.value, key, "right") - 1
            groups = [list(range(max(0, a), z + 1)) for a, z in zip(to.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(groups, pa.list_(pa.int64()))], names=["key", "groups"])

    def work(table: pa.Table) -> pa.Table:
        store, at = fs.FileSystem.from_uri(directory)
        with store.open_input_file(f"{at}/{table.column('file')[0].as_py()}") as source:
            s = Shard(source)
            key = table.column("key").to_numpy()
            found = s.find(key)
            hit = np.flatnonzero(found >= 0)
            ids = [s.document(i).astype("<u4").tobytes() for i in found[hit].tolist()]
        return pa.Table.from_arrays([pa.array(key[hit]), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    asked = keys.select(F.col(id_col).cast("long").alias("key")).where("key is not null").distinct()
    routed = asked.mapInArrow(route, "key long, groups array<long>").select("key", F.explode("groups").alias("group"))
    held = routed.join(grouped.select("group", "file", "first", "last", "before"), "group").where(F.col("key").between(F.col("first"), F.col("last")))
    shard = held.groupBy("key").agg(F.min_by("file", "before").alias("file"))
    return shard.groupBy("file").applyInArrow(work, "doc_id long, ids binary")
