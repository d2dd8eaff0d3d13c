"""Scoring texts by a smoothed trigram model in the form of a weighted backoff automaton.

Words are the symbols, and an end symbol closes every text.  States are the
contexts seen in training: two words, one word, and the root without any.  An arc
of a state is an n-gram that begins with its context; it leads to the longest
context that is then read.  Where a state has no arc for a symbol, its failure arc
leads to the state of the context without its first word.  With Dirichlet
smoothing at every order

    arc of u v     P(w | u v) = (c(u v w) + k3 P(w | v)) / (c(u v) + k3)
    its failure               =            k3            / (c(u v) + k3)
    arc of v       P(w | v)   = (c(v w) + k2 P(w)) / (c(v) + k2)
    its failure               =         k2         / (c(v) + k2)
    root           P(w)       = (1 - x) c(w) / N,   P(unknown) = x

x is the share of words seen once (Good-Turing), and k2 and k3 make the expected
failure mass of their order equal the share of its n-grams seen once; all come
from counts over all training texts.

The model grows with the corpus, so it is never gathered in one place.  Texts are
cut into chunks; a chunk asks for the counts of its distinct n-grams.  Requests
and replies are arrays of sorted hashes for each chunk and hash range, and the
task of a hash range adds up what all chunks sent and replies to each.  With its
replies a chunk holds the part of the automaton that its texts can reach, and
traverses it once from left to right, many texts at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_texts, factorize, hash_words, mix, portions, text_column, words_of

#: Bytes of text in a chunk.
CHUNK = 8_000_000
ORDER = 3
#: Tokens that one lane of the traversal reads.
LANE = 512
#: Bits that a hash of an n-gram has beyond those that number all tokens: one n-gram in
#: 2 ** SPARE_BITS is expected to meet another's hash.  Words always have 64.
SPARE_BITS = 20
#: Codes of the end of a text and of the state before its first word.
END, BEGIN = np.uint64(1), np.uint64(2)
CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, sizes binary, words binary, codes binary, n_tokens long"
REQUESTS = "kind int, bucket int, chunk long, keys binary, counts binary"
REPLIES = "kind int, bucket int, chunk long, counts binary, tokens long, types long, ones long, mass array<long>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    ids, held, words, size = [], [], [], 0

    def row() -> pa.RecordBatch:
        flat = [w for t in words for w in (*t, b"")]  # the empty word ends a text
        codes, distinct = factorize(flat)
        hashes = hash_words(distinct)
        hashes[[i for i, w in enumerate(distinct) if not w]] = END
        # frequent words get small codes, whose upper bytes compress away
        often = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often), dtype=np.uint32)
        hashes = hashes[often]
        sizes = np.array([len(t) + 1 for t in words], np.int64)
        cols = [[(task << 32) | seq], [ids], [held], [sizes.tobytes()], [hashes.tobytes()], [by_bytes(place[codes])], [len(codes)]]
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["chunk", "doc_ids", "held", "sizes", "words", "codes", "n_tokens"])

    for b in portions(batches, "text", CHUNK):
        for key, out, text in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), column_texts(b, "text"), strict=True):
            ids.append(key)
            held.append(bool(out))
            words.append(words_of(text))
            size += len(text) + 8
            if size >= CHUNK:
                yield row()
                ids, held, words, size, seq = [], [], [], 0, seq + 1
    if ids:
        yield row()


class Chunk:
    """One chunk's texts as hashed words, with the distinct n-grams of every order in key order.

    ``keys[n]`` are the sorted keys of the n-grams of n + 1 words, ``at[n]`` is each
    token's n-gram that ends there (-1 where the text has not so many words before
    it; the place before the first word counts as one) and ``seen[n]`` a token where
    each n-gram ends.
    """

    def __init__(self, row: dict, bits: int = 64):
        self.ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        words, codes = np.frombuffer(row["words"], np.uint64), from_bytes(row["codes"], np.uint32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held, self.sizes)
        # distinct words in order of their hashes; equal hashes are one word
        distinct, place = np.unique(words, return_inverse=True)
        word = place[codes].astype(np.int32)
        last = np.empty(len(distinct), np.int64)
        last[word] = np.arange(len(word))
        self.keys, self.at, self.seen, self.widths = [distinct], [word], [last], [64, *[bits] * (ORDER - 1)]
        gram = distinct[word]
        for n in range(1, ORDER):
            before = np.empty(len(gram), np.uint64)
            before[1:], before[:1] = gram[:-1], BEGIN
            there = np.ones(len(gram), bool)
            if n == 1:
                before[self.starts] = BEGIN
            else:  # so many words must come before, of which the place before the first is one
                for k in range(n - 1):
                    there[np.minimum(self.starts + k, self.starts + self.sizes - 1)] = False
            gram = mix(before, distinct[word])
            keys, inv = np.unique(gram[there] >> np.uint64(64 - bits), return_inverse=True)
            at = np.full(len(gram), -1, np.int32)
            at[there] = inv
            seen = np.empty(len(keys), np.int64)
            seen[inv] = np.flatnonzero(there)
            self.keys.append(keys)
            self.at.append(at)
            self.seen.append(seen)

    def counts(self) -> list[np.ndarray]:
        """Training counts of the distinct n-grams of every order."""
        return [np.bincount(at[self.train & (at >= 0)], minlength=len(keys)) for keys, at in zip(self.keys, self.at, strict=True)]

    def before(self) -> np.ndarray:
        """The word before each token; before a text's first word the number of words."""
        out = np.empty(len(self.at[0]), np.int32)
        out[1:] = self.at[0][:-1]
        out[self.starts] = len(self.keys[0])
        return out


def _ranges(keys: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Where each hash range begins in sorted keys of ``width`` bits, and the end."""
    return np.searchsorted(keys >> np.uint64(width - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def by_bytes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes, then the next; like bytes compress well."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()


def from_bytes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def planes(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte by byte."""
    return by_bytes(np.diff(keys, prepend=np.uint64(0)))


def unplanes(raw: bytes) -> np.ndarray:
    return np.cumsum(from_bytes(raw, np.uint64), dtype=np.uint64)


def _requests(bits: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                c = Chunk(row, width)
                for kind, (keys, counts) in enumerate(zip(c.keys, c.counts(), strict=True)):
                    cuts = _ranges(keys, c.widths[kind], bits)
                    some = np.flatnonzero(np.diff(cuts))
                    cols = [
                        pa.array(np.full(len(some), kind, np.int32)),
                        pa.array(some.astype(np.int32)),
                        pa.array(np.full(len(some), row["chunk"], np.int64)),
                        pa.array([planes(keys[cuts[j] : cuts[j + 1]]) for j in some], pa.binary()),
                        pa.array([by_bytes(counts[cuts[j] : cuts[j + 1]].astype(np.uint32)) for j in some], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["kind", "bucket", "chunk", "keys", "counts"])

    return work


def _reply(table: pa.Table) -> pa.Table:
    """One hash range: totals of all chunks' counts, back to each chunk in its key order."""
    keys = [unplanes(x) for x in table.column("keys").to_pylist()]
    counts = [from_bytes(x, np.uint32) for x in table.column("counts").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(at, np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    n = len(keys)
    seen = totals[totals > 0]
    log = np.bincount(np.floor(np.log2(np.maximum(seen, 1)) * 4).astype(np.int64), seen, minlength=1).astype(np.int64).tolist()
    only_first = lambda x, none: [x, *[none] * (n - 1)]  # noqa: E731  the range's own figures stand in one row
    cols = [
        table.column("kind").combine_chunks(),
        table.column("bucket").combine_chunks(),
        table.column("chunk").combine_chunks(),
        pa.array([by_bytes(totals[p].astype(np.uint32 if totals.max(initial=0) < 2**32 else np.uint64)) for p in np.split(at, ends[:-1])], pa.binary()),
        pa.array(only_first(int(seen.sum()), 0), pa.int64()),
        pa.array(only_first(len(seen), 0), pa.int64()),
        pa.array(only_first(int((seen == 1).sum()), 0), pa.int64()),
        pa.array(only_first(log, []), pa.list_(pa.int64())),
    ]
    return pa.Table.from_arrays(cols, names=["kind", "bucket", "chunk", "counts", "tokens", "types", "ones", "mass"])


def failure_weight(mass: dict[int, int], unseen: float) -> float:
    """k for which the expected failure mass is ``unseen``.

    mass: tokens by the context's count, in quarter powers of two.
    """
    total = sum(mass.values())
    if not total or unseen <= 0:
        return 1.0
    share = lambda k: sum(m * k / (2 ** ((q + 0.5) / 4) + k) for q, m in mass.items()) / total
    lo, hi = 1e-3, 1e9
    for _ in range(80):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if share(mid) < unseen else (lo, mid)
    return lo


class Automaton:
    """The part of the backoff automaton that a chunk reaches; weights are log10.

    State 0 is the root, then come the words, the place before the first word and
    the pairs of words.  Arcs are numbered like the n-grams: words, pairs, triples.
    """

    def __init__(self, c: Chunk, counts: list[np.ndarray], tokens: int, texts: int, unknown: float, k: list[float]):
        (words, pairs, triples), (k2, k3) = counts, k
        n, before = len(words), c.before()
        p1 = np.where(words > 0, (1 - unknown) * words / max(1, tokens), unknown)
        # contexts of one word, the place before the first word among them
        one = np.append(words, texts).astype(np.float64)
        last, first = c.at[0][c.seen[1]], before[c.seen[1]]
        p2 = np.where(one[first] > 0, (pairs + k2 * p1[last]) / (one[first] + k2), p1[last])
        tail, head = c.at[1][c.seen[2]], c.at[1][c.seen[2] - 1]
        p3 = np.where(pairs[head] > 0, (triples + k3 * p2[tail]) / (pairs[head] + k3), p2[tail])
        self.begin = 1 + n if texts else 0
        self.order = np.concatenate([np.zeros(1, np.int8), np.ones(n + 1, np.int8), np.full(len(pairs), 2, np.int8)])
        with np.errstate(divide="ignore"):
            self.failure = np.concatenate([[0.0], np.log10(k2 / (one + k2)), np.log10(k3 / (pairs + k3))])
        self.fails_to = np.concatenate([np.zeros(n + 2, np.int32), 1 + last.astype(np.int32)])
        # an unknown word leads to the root, a known n-gram to the longest context in it
        state = [np.where(words > 0, np.arange(1, n + 1), 0), n + 2 + np.arange(len(pairs))]
        self.leads_to = np.concatenate([*state, n + 2 + tail]).astype(np.int32)
        self.weight = np.log10(np.concatenate([p1, p2, p3]))
        # each token's arc from a context of 0, 1 or 2 words; -1 where training has not seen it
        self.arcs, base = np.empty((ORDER, len(c.at[0])), np.int32), 0
        for order, at in enumerate(c.at):
            known = at >= 0
            if order:
                known &= counts[order][at] > 0
            self.arcs[order] = np.where(known, base + at, -1)
            base += len(counts[order])

    def traverse(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log probability of each token.

        Texts are read in lanes of ``LANE`` tokens, all lanes a token at a time, each
        carrying its state.  A lane within a text first reads, from the root and
        without a score, the words that its state is made of.
        """
        arcs, width = self.arcs.ravel(), self.arcs.shape[1]
        out = np.zeros(width)
        lanes = -(-sizes // LANE)
        place = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        lead = np.where(place > 0, ORDER - 1, 0)
        begin = np.repeat(starts, lanes) + place * LANE - lead
        size = np.minimum(LANE, np.repeat(sizes, lanes) - place * LANE) + lead
        longest = np.argsort(-size, kind="stable")
        begin, size, lead = begin[longest], size[longest], lead[longest]
        state = np.where(lead > 0, 0, self.begin)
        for step in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -step, side="left"))  # lanes that are longer
            token, state = begin[:n] + step, state[:n]
            arc = arcs[self.order[state] * np.int64(width) + token]
            score = np.zeros(n)
            fails = np.flatnonzero(arc < 0)
            while len(fails):
                of = state[fails]
                score[fails] += self.failure[of]
                state[fails] = self.fails_to[of]
                arc[fails] = arcs[self.order[state[fails]] * np.int64(width) + token[fails]]
                fails = fails[arc[fails] < 0]
            score += self.weight[arc]
            state = self.leads_to[arc]
            if step < ORDER - 1:
                read = step >= lead[:n]
                out[token[read]] = score[read]
            else:
                out[token] = score
        return out


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", chunk_ranges: int = 0) -> DataFrame:
    """Base (add-one unigram) and model log10 probabilities of every text.

    ``held_out``: a boolean column; only rows where it is not true are learnt from.
    A null or empty text is the end symbol alone.  Rows of equal or null ids are
    texts of their own.  Without training texts every token has the base's
    uniform probability.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = scratch.write(rows.mapInArrow(_chunks, CHUNKS), "chunks")
    n_chunks, texts, read = chunks.agg(F.count("*"), F.sum(F.size(F.filter("held", lambda x: ~x))), F.sum("n_tokens")).first()
    # so many hash ranges that one holds the requests of about two chunks' worth of text
    bits = chunk_ranges or max(6, math.ceil(math.log2(max(1, n_chunks) / 2)))
    width = min(64, (read or 0).bit_length() + SPARE_BITS)
    asked = chunks.mapInArrow(_requests(bits, width), REQUESTS)
    replies = scratch.write(asked.groupBy("kind", "bucket").applyInArrow(_reply, REPLIES), "replies")
    sums = {r["kind"]: r for r in replies.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.sum("ones").alias("ones")).collect()}
    masses = replies.where("kind < 2").select("kind", F.posexplode("mass").alias("q", "m")).groupBy("kind", "q").agg(F.sum("m").alias("m")).collect()
    tokens, types, ones = (int(sums[0][c]) if sums else 0 for c in ("tokens", "types", "ones"))
    unknown = min(0.5, (ones + 0.5) / (tokens + 1)) if tokens else 1.0
    share = lambda n: int(sums[n]["ones"]) / max(1, int(sums[n]["tokens"])) if n in sums else 1.0
    k = [failure_weight({int(r["q"]): int(r["m"]) for r in masses if r["kind"] == n - 1}, share(n)) for n in range(1, ORDER)]
    texts = int(texts or 0)

    def finish(key, chunk: pa.Table, reply: pa.Table) -> pa.Table:
        c = Chunk(chunk.to_pylist()[0], width)
        order = np.argsort(reply.column("bucket").to_numpy(), kind="stable")
        kinds, raw = reply.column("kind").to_numpy()[order], reply.column("counts").to_pylist()
        found = []
        for kind, keys in enumerate(c.keys):
            # a range's replies are 4 bytes wide, or 8 where its counts need it
            parts = [raw[i] for i, x in zip(order, kinds, strict=True) if x == kind]
            sizes = np.diff(_ranges(keys, c.widths[kind], bits))
            counts = [from_bytes(p, np.uint32 if len(p) == 4 * w else np.uint64).astype(np.int64) for p, w in zip(parts, sizes[sizes > 0], strict=True)]
            found.append(np.concatenate([*counts, np.zeros(0, np.int64)]))
            assert len(found[kind]) == len(keys)
        count = found[0][c.at[0]]
        base = np.log10((count + 1) / (tokens + types + 1))
        model = Automaton(c, found, tokens, texts, unknown, k).traverse(c.starts, c.sizes)
        total = lambda x: np.add.reduceat(x, c.starts)
        cols = [pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(c.sizes), pa.array(total((count > 0).astype(np.int64))), pa.array(np.full(len(c.sizes), tokens, np.int64)), pa.array(total(base)), pa.array(total(model))]
        return pa.Table.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = replies.select("chunk", "kind", "bucket", "counts")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
