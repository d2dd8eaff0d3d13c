"""Packing documents into training sequences by lexical retrieval.

Document frequencies, the number of documents and their mean length are counted
over the whole corpus first.  Then documents are dealt by a weighted MinHash of
their terms, so that lexically near ones meet: two documents agree in a value of
it with the probability of their weighted Jaccard similarity.  Every task works
through its documents in that order, in shards of bounded size.  A shard keeps
a BM25 inverted index over the token ids of its documents.  A seed document opens
a window; the index returns the unused documents that are nearest to it, best
first, and those that fit fill the window.  What room is left goes to the head
of the best neighbour that did not fit, whose rest is the next seed.  So every
window of a shard is full but the last, whose content is cut into sequences of
powers of two, which need no padding.

A neighbour that the dealing puts into another shard is not found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import BLOCK_CHARS, library_encoder, vocabulary
from .common import Scratch, column_texts, mix, portions, text_column

WINDOW = 2048
#: Token ids of a shard: its index and its ids are held by one task.
SHARD_IDS = 3_000_000
#: Terms that more than this share of a shard's documents have are kept as whole rows of weights.
DENSE = 0.25
#: Used documents leave a shard's postings when this share of those left in has been used.
DROP = 0.1
#: MinHash values by which documents are dealt.
KEYS = 3
K1, B = 1.2, 0.75
#: In the place of a term, the number of documents and that of ids.
DOCS, IDS = -1, -2
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Corpus:
    """Statistics of all documents: each term's document frequency, the number of documents, the mean length."""

    def __init__(self, terms: np.ndarray, df: np.ndarray, n: int, ids: int):
        self.df = np.zeros(int(terms.max()) + 1 if len(terms) else 1, np.int64)
        self.df[terms] = df
        self.n, self.mean = n, ids / max(1, n)
        every = np.arange(len(self.df))
        draws = [(mix(every.astype(np.uint64), np.full(len(every), k + 1, np.uint64)) >> np.uint64(11)) / 2.0**53 for k in range(KEYS)]
        #: for each value, the terms in the order of their waits, and each term's place in it
        self.first = [np.argsort(-np.log(draw + 1e-18) / self.idf(every), kind="stable") for draw in draws]
        self.place = [np.argsort(first).astype(np.int32) for first in self.first]

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[terms]
        return np.log1p((self.n - df + 0.5) / (df + 0.5))

    def keys(self, ids: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """``KEYS`` values of a weighted MinHash of each document: the term that comes first when each waits by its weight."""
        terms = [first[np.minimum.reduceat(place[ids], begins)] for first, place in zip(self.first, self.place, strict=True)]
        # terms are ordered by a hash, which spreads them evenly
        return [mix(t.astype(np.uint64), np.full(len(t), 99, np.uint64)).view(np.int64) for t in terms]


class Index:
    """BM25 weights of the terms of a shard's documents, in postings by term."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        sizes = np.array([len(d) for d in docs], np.int64)
        doc = np.repeat(np.arange(len(docs)), sizes)
        term = np.concatenate(docs).astype(np.int64)
        pair, tf = np.unique(term * len(docs) + doc, return_counts=True)
        term, self.doc = np.divmod(pair, len(docs))
        self.terms, self.begin, df = np.unique(term, return_index=True, return_counts=True)
        self.end, self.n = self.begin + df, len(docs)
        idf = corpus.idf(self.terms) if corpus else np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, corpus.mean if corpus else sizes.mean()))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        #: each document's terms that some other document has: those of many documents, and the rest
        code = np.repeat(np.arange(len(df)), df)
        many = df > max(1, DENSE * self.n)
        self.row = np.cumsum(many) - 1
        self.rows = np.zeros((int(many.sum()), self.n), np.float32)
        at = many[code]
        self.rows[self.row[code[at]], self.doc[at]] = self.weight[at]
        self.many, self.few = (self._queries(code, which) for which in (many, ~many & (df > 1)))

    def _queries(self, code: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(which[code])
        at = at[np.argsort(self.doc[at], kind="stable")]
        return code[at], np.searchsorted(self.doc[at], np.arange(self.n + 1))

    def drop(self, used: np.ndarray) -> None:
        """Takes used documents out of the postings; the scores of the others stay as they are."""
        stays = ~used[self.doc]
        place = np.concatenate([[0], np.cumsum(stays)])
        self.begin, self.end = place[self.begin], place[self.end]
        self.doc, self.weight = self.doc[stays], self.weight[stays]

    def scores(self, seed: int, used: np.ndarray) -> np.ndarray:
        """The score of each document, 0 for used ones and those that share no term with the seed; every distinct term of the seed counts once."""
        few, many = (terms[begin[seed] : begin[seed + 1]] for terms, begin in (self.few, self.many))
        begin, size = self.begin[few], (self.end - self.begin)[few]
        take = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.doc[take], self.weight[take], minlength=self.n)
        score = score + self.rows[self.row[many]].sum(axis=0)
        score[used] = 0
        return score

    def nearest(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        score = self.scores(seed, used)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard's documents."""
    out, sequence = [], 0
    begin = np.zeros(len(docs), np.int64)
    left = np.array([len(d) for d in docs], np.int64)
    for d in np.flatnonzero(left >= window).tolist():  # what fills windows by itself
        for _ in range(int(left[d] // window)):
            out.append((d, int(begin[d]), window, sequence, 0))
            begin[d] += window
            sequence += 1
        left[d] %= window
    used = left == 0
    if used.all():
        return out
    index, waiting, seed = Index(docs, corpus), iter(np.flatnonzero(~used).tolist()), -1
    room, held, dropped = window, [], 0

    def place(d: int, n: int) -> None:
        nonlocal room
        held.append((d, int(begin[d]), n))
        begin[d] += n
        left[d] -= n
        room -= n
        used[d] = left[d] == 0

    while True:
        if seed < 0:
            seed = next((d for d in waiting if not used[d]), -1)
            if seed < 0:
                break
        at, seed = seed, -1
        place(at, int(min(left[at], room)))
        if not used[at]:
            seed = at  # its rest opens the next window
        if room:
            gone = int(used.sum())
            if gone - dropped > DROP * (len(docs) - dropped):
                index.drop(used)
                dropped = gone
            score = index.scores(at, used)
            # only what may fit is put in order
            fit = np.flatnonzero((score > 0) & (left <= room))
            fit = fit[np.argsort(-score[fit], kind="stable")]
            for d, n in zip(fit.tolist(), left[fit].tolist(), strict=True):
                if n <= room:
                    place(d, n)
                    score[d] = 0
                    if not room:
                        break
            if room:
                best = int(score.argmax())
                if score[best] > 0:
                    seed = best
                    place(seed, room)
                else:
                    seed = next((d for d in waiting if not used[d]), -1)
                    if seed >= 0:
                        continue  # the window goes on with another seed
        if not room or seed < 0:
            if room:
                break
            out += _laid(held, sequence)
            sequence, room, held = sequence + 1, window, []
            if seed >= 0 and used[seed]:
                seed = -1
    while held:  # the last, unfilled window
        size = sum(n for _, _, n in held)
        cut = 1 << (size.bit_length() - 1)
        first, rest = [], []
        for d, a, n in held:
            take = min(n, cut)
            cut -= take
            if take:
                first.append((d, a, take))
            if n > take:
                rest.append((d, a + take, n - take))
        out += _laid(first, sequence)
        sequence, held = sequence + 1, rest
    return out


def _laid(held: list[tuple[int, int, int]], sequence: int) -> list[tuple[int, int, int, int, int]]:
    out, offset = [], 0
    for d, a, n in held:
        out.append((d, a, n, sequence, offset))
        offset += n
    return out


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every piece with its ids (little-endian unsigned 32-bit, as binary).

    ``sequence_id`` is unique over the table; ``offset`` is the piece's place in
    its sequence.  A null or empty text is the end id alone.  Rows of equal or
    null ids are documents of their own.  Other columns are not read.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's ids; the task's last row holds its document frequencies instead."""
        enc, end, names = library_encoder(path), np.array([end_id], "<u4"), ["doc_id", "ids", "terms"]
        df, n, total = np.zeros(max(vocabulary(path).size, end_id + 1), np.int64), 0, 0
        last = np.zeros(len(df), np.int64)
        for b in portions(batches, "text", 2 * BLOCK_CHARS):
            ids = [y for x in enc.encode(column_texts(b, "text")) for y in (x, end)]
            ends = np.cumsum([len(x) for x in ids])[1::2]
            flat = np.concatenate(ids).astype("<u4", copy=False)
            place = np.arange(len(flat))
            begin = 0
            for until in ends.tolist():
                # a term counts where it stands last in the document
                x, at = flat[begin:until], place[begin:until]
                last[x] = at
                df[x[last[x] == at]] += 1
                begin = until
            n, total = n + len(ends), total + len(flat)
            offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), column, pa.nulls(len(ends), pa.binary())], names=names)
        terms = np.flatnonzero(df)
        counts = np.stack([np.append(terms, [DOCS, IDS]), np.append(df[terms], [n, total])])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=names)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("terms"):
                terms, df = np.frombuffer(x.as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df)], names=["term", "df"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pa.compute.binary_length(b.column("ids"))).astype(np.int64) // 4
            flat = np.frombuffer(b"".join(x.as_py() for x in b.column("ids")), "<u4")
            found = shared.value.keys(flat, np.cumsum(sizes) - sizes) if b.num_rows else [np.zeros(0, np.int64)] * KEYS
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), *map(pa.array, found)], names=["doc_id", "ids", *names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        docs, ids, held, sequences = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, ids, held, sequences
            pieces = pack(ids, window, shared.value)
            for k in range(0, len(pieces), 2000):
                d, a, n, s, o = zip(*pieces[k : k + 2000], strict=True)
                raw = [ids[x][b : b + c].tobytes() for x, b, c in zip(d, a, n, strict=True)]
                cols = [[docs[x] for x in d], a, n, [len(ids[x]) for x in d], [base + sequences + x for x in s], o]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(raw, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            sequences += max(p[3] for p in pieces) + 1
            docs, ids, held = [], [], 0

        for b in batches:
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                docs.append(doc)
                ids.append(np.frombuffer(x.as_py(), "<u4"))
                held += len(ids[-1])
                if held >= SHARD_IDS:
                    yield from flush()
        if docs:
            yield from flush()

    spark, names = docs.sparkSession, [f"key{k}" for k in range(KEYS)]
    scratch = Scratch(spark, "packing")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    rows = scratch.write(texts.mapInArrow(tokenise, "doc_id long, ids binary, terms binary"))
    # at most a row for each id of the vocabulary, and the two totals
    counted = rows.where("terms is not null").select("terms").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    totals = dict(counted[counted["term"] < 0].itertuples(index=False))
    n, total = int(totals.get(DOCS, 0)), int(totals.get(IDS, 0))
    counted = counted[counted["term"] >= 0]
    shared = spark.sparkContext.broadcast(Corpus(counted["term"].to_numpy(np.int64), counted["df"].to_numpy(np.int64), n, total))
    keyed = rows.where("ids is not null").select("doc_id", "ids").mapInArrow(keys, "doc_id long, ids binary, " + ", ".join(f"{k} long" for k in names))
    # equal keys of many copies are spread by a hash of the row; sampling for the ranges reads keys and hash only
    keyed = scratch.write(keyed.withColumn("spread", F.xxhash64("doc_id", "ids")))
    scratch.drop(rows)
    order = [*names, "spread"]
    dealt = keyed.repartitionByRange(max(1, -(-total // SHARD_IDS)), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(work, PIECES)
