"""What the operators of this subpackage share: scratch tables in the shared
folder, words of texts, and a numpy hash table."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the bytes that separate words.
SPACES = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, one of our own if the driver runs all tasks; else an error, as
    executors don't see the driver's folders.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lumaquery-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_folders: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this driver; for when the results have been written."""
    while _folders:
        delete(spark, _folders.pop())


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written once into the shared folder, to cut lineage and to be read
    several times.  They outlive the loss of executors, and stay until ``clear_scratch``,
    as results are read lazily."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _folders.append(self.at)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.at}/{name}{self.n}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        self.remove(getattr(df, "_scratch", None))

    def remove(self, path: str | None) -> None:
        if path:
            delete(self.spark, path)


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_column(df: DataFrame, column: str = "text"):
    """The column as a string, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: str) -> list[bytes]:
    """Words between white space, A-Z in lower case, as UTF-8.

    ``bytes.split`` and ``bytes.lower`` know ASCII only, which is just what is wanted.
    """
    return text.encode("utf-8", "replace").lower().split()


def column_texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def portions(batches: Iterable[pa.RecordBatch], name: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``chars`` bytes of text, or one row."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(name)), 0))
        part = np.cumsum(sizes) // chars
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes (XXH64, seed 42, as Spark's xxhash64 of a string)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))


def factorize(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Index of each word among the distinct words, and these."""
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    return codes, list(index)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit number for an ordered pair of 64-bit numbers."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class HashTable:
    """Positions of 64-bit keys, looked up many at a time (open addressing).

    The slots are laid out at the first look-up and never sent: where tables are only
    passed on, as on the driver, there are just the keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.keys, self.slots = keys, None

    def __reduce__(self):
        return HashTable, (self.keys,)

    def _lay_out(self) -> None:
        keys = self.keys
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, probe = np.arange(len(keys), dtype=np.int32), 0
        while len(todo):
            at = self._at(keys[todo], probe)
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several, one stays
            todo = todo[self.slots[at] != todo]
            probe += 1
        self.probes = probe

    def _at(self, keys: np.ndarray, probe: int) -> np.ndarray:
        spread = keys * np.uint64(0x9E3779B97F4A7C15)
        return (((spread >> np.uint64(64 - self.bits)) + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is absent."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return found
        if self.slots is None:
            self._lay_out()
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            slot = self.slots[self._at(keys[todo], probe)]
            there = slot >= 0
            todo, slot = todo[there], slot[there]
            hit = self.keys[slot] == keys[todo]
            found[todo[hit]] = slot[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return found


#: The largest table that is broadcast by hint, by its measured content.
BROADCAST_BYTES = 16_000_000


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its content is measured to be at most ``limit``
    bytes; a larger one stays as it is and is joined by shuffle.  Its columns are strings or numbers."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(8) for f in df.schema]
    row = sum(sizes[1:], sizes[0]).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= limit else df


def release_memory() -> None:
    """Gives memory that Python no longer uses back to the system, after work on the driver; without effect where that can't be asked for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
