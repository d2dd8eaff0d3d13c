"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct words of a batch lie in one flat array of symbols.  In every round
each unfinished word finds its lowest-rank pair (binary search over the sorted
keys of all mergeable pairs) and merges it wherever it stands in the word; ranks
are searched anew only beside what was merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import BLOCK_CHARS, Vocabulary, WordEncoder, byte_chars, vocabulary
from .common import column_texts, portions, text_column

NONE = np.int32(2**31 - 1)


class Merges:
    """Sorted pair keys with the rank and the merged symbol of each."""

    def __init__(self, vocab: Vocabulary):
        ids, self.width = vocab.ids, vocab.size
        self.byte_ids = np.array([ids[c] for c in byte_chars()[0]], np.int64)
        keys = np.array([ids[a] * self.width + ids[b] for a, b in vocab.merges], np.int64)
        _, first = np.unique(keys, return_index=True)  # sorted; the earliest rank of a pair counts
        self.keys, self.ranks = keys[first], first.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in vocab.merges], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the number of ids of each."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        rank = np.full(len(symbol), NONE, np.int32)  # of the pair that starts here
        if len(symbol) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self.rank(symbol[:-1], symbol[1:]), NONE)
        done_symbol, done_word = [], []
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(best < NONE, sizes)
            if not open_.all():
                done_symbol.append(symbol[~open_])
                done_word.append(word[~open_])
                symbol, word, rank = symbol[open_], word[open_], rank[open_]
                best, sizes = best[best < NONE], sizes[best < NONE]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # pairs that overlap (aaa): every other one, from the left
            run = np.flatnonzero(np.append(True, np.diff(at) != 1))
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            new_at = np.cumsum(stays)[at] - 1
            symbol, word, rank = symbol[stays], word[stays], rank[stays]
            look = np.concatenate([new_at, new_at[new_at > 0] - 1])
            after = np.minimum(look + 1, len(symbol) - 1)
            pair = (word[look] == word[after]) & (after > look)
            rank[look] = np.where(pair, self.rank(symbol[look], symbol[after]), NONE)
        flat, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbol, done_word))
        order = np.argsort(of, kind="stable")
        return flat[order].astype(np.uint32), np.bincount(of, minlength=len(raw))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder for a vocabulary file; one a worker."""
    if path not in _encoders:
        vocab = vocabulary(path)
        _encoders[path] = WordEncoder(vocab, Merges(vocab).encode_words)
    return _encoders[path]


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids, special tokens included; what is not UTF-8 becomes U+FFFD."""
    table = vocab.bytes_of
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit, as binary) of every row.

    A null or empty text has no ids.  With ``decoded`` the text decoded from the
    ids comes along.  Equal rows give equal rows; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, enc = vocabulary(path), encoder(path)
        for b in portions(batches, "text", 2 * BLOCK_CHARS):
            ids = list(enc.encode(column_texts(b, "text")))
            cols = [b.column("doc_id"), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())]
            if decoded:
                cols.append(pa.array([decode_ids(vocab, i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][: len(cols)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``, null for null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            texts = [None if x is None else decode_ids(vocab, np.frombuffer(x, "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")
