"""SimHash, language model, token ids, BPE and packing against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumaquery.llm import bpe, bytelevel, lm, packing, queries, simhash, tokenids
from lumaquery.llm.common import HashTable, Scratch
from lumaquery.llm.mph import PerfectHash

PATH = queries.tokenizer_path()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def simhash_plain(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components_plain(rows):
    """Smallest id reachable from each fingerprint."""
    ids = defaultdict(set)
    for i, t in rows:
        if i is not None:
            ids[simhash_plain(t)].add(i)
    fps = list(ids)
    low = {f: min(ids[f]) for f in fps}
    links = [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 3 or ids[a] & ids[b]]
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_simhash(table, request):
    df = request.getfixturevalue(table)
    rows = rows_of(df)
    low = components_plain(rows)
    want = Counter((i, simhash_plain(t), low.get(simhash_plain(t))) for i, t in rows)
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.components(df).collect())
    assert got == want


def test_simhash_chunks_of_a_bucket(spark):
    """Chunks much smaller than a bucket lose no link."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(1, 2**62))
    fps = {base}
    for _ in range(120):
        x = list(fps)[rng.integers(len(fps))]
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    rows = [(x - 2**64 if x >> 63 else x, k) for k, x in enumerate(sorted(fps))]
    table = spark.createDataFrame(rows, "fp long, node long")
    from lumaquery.llm.components import connected_components

    s = Scratch(spark, "t")
    found = dict(connected_components(spark, s, simhash.links(s, table, 3, 7)).collect())
    low = {k: k for _, k in rows}
    for _ in rows:
        for fa, a in rows:
            for fb, b in rows:
                if ((fa ^ fb) & (2**64 - 1)).bit_count() <= 3:
                    low[a] = low[b] = min(low[a], low[b])
    assert {k: found.get(k, k) for k in low} == low


def test_masks_cover():
    import itertools

    m = [x & (2**64 - 1) for x in simhash.masks()]
    for places in itertools.combinations(range(0, 64), 3):
        d = sum(1 << p for p in places)
        assert any(not x & d for x in m)


def test_simhash_empty(none):
    assert simhash.components(none).collect() == []


def lm_plain(rows):
    """The interpolated trigram model written down directly, without an automaton."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, pairs, triples = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = [*words(t), None]
            c.update(w)
            pairs.update(zip(["BOS", *w], w, strict=False))
            triples.update(zip(["BOS", *w], w, w[1:], strict=False))
    n, v = sum(c.values()), len(c)
    texts = sum(not held(i) for i, _ in rows)
    ones = lambda x: sum(n == 1 for n in x.values())
    u = min(0.5, (ones(c) + 0.5) / (n + 1)) if n else 1.0

    def weight(contexts, grams):
        mass = Counter()
        for x in contexts.values():
            mass[math.floor(math.log2(x) * 4)] += x
        return lm.failure_weight(mass, ones(grams) / max(1, sum(grams.values())))

    k2, k3 = weight(c, pairs), weight(pairs, triples)

    def p(x, h="", g=""):
        if g:
            return (triples[g, h, x] + k3 * p(x, h)) / (pairs[g, h] + k3) if pairs[g, h] else p(x, h)
        if h:
            ch = texts if h == "BOS" else c[h]
            return (pairs[h, x] + k2 * p(x)) / (ch + k2) if ch else p(x)
        return (1 - u) * c[x] / n if c[x] else u

    out = []
    for i, t in rows:
        w = [*words(t), None]
        past = ["", "BOS", *w]
        s = sum(math.log10(p(x, past[j + 1], past[j])) for j, x in enumerate(w))
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, base, s))
    return out


@pytest.mark.parametrize(("table", "lane"), [("odd", 512), ("odd", 3), ("docs", 512), ("docs", 64)])
def test_lm(table, lane, request, monkeypatch):
    df = request.getfixturevalue(table)
    monkeypatch.setattr(lm, "LANE", lane)
    want, got = lm_plain(rows_of(df)), [tuple(r) for r in lm.score(df, queries.remainder(7)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want, got = sorted(want, key=key), sorted(got, key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9)


def test_lm_of_many_small_chunks(docs, monkeypatch):
    whole = {r.doc_id: r.score for r in lm.score(docs, queries.remainder(7)).collect()}
    monkeypatch.setattr(lm, "CHUNK", 20_000)
    parts = {r.doc_id: r.score for r in lm.score(docs, queries.remainder(7), chunk_ranges=3).collect()}
    assert whole.keys() == parts.keys() and np.allclose([whole[i] for i in whole], [parts[i] for i in whole])


def test_lm_beats_base_on_held_out(docs):
    rows = [r for r in lm.score(docs, queries.remainder(7)).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_tells_repeats_apart(spark):
    """A text that the corpus holds twice is likelier by the word than one it holds once."""
    rng = np.random.default_rng(6)
    text = lambda: " ".join(f"w{x}" for x in (rng.zipf(1.3, 120) % 3000))
    texts = [text() for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(texts[:60])]
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()
    gain = {r.doc_id: r.score / r.n_tokens for r in out}
    twice, once = (np.array([gain[k] for k in part]) for part in (range(60), range(60, 300)))
    assert np.mean(twice[:, None] > once[None, :]) > 0.98


def test_lm_adds_up_to_one():
    """The automaton's probabilities after every context add up to one over all words and the unknown one."""
    texts = ["a b a c", "a b", "b a b c", "c"]
    vocabulary = ["a", "b", "c", None]
    hashes = dict(zip(vocabulary, np.array([11, 12, 13, 1], np.uint64), strict=True)) | {"?": np.uint64(99)}
    context = [x.split() for x in ("a b", "b a", "a", "c", "", "c b", "? a")]
    probes = [[*h, x] for h in context for x in [*vocabulary, "?"]]
    every = [[*t.split(), None] for t in texts] + probes
    flat = [w for t in every for w in t]
    distinct = list(dict.fromkeys(flat))
    row = {"doc_ids": list(range(len(every))), "held": [k >= 4 for k in range(len(every))], "sizes": np.array([len(t) for t in every], np.int64).tobytes()}
    row |= {"words": np.array([hashes[w] for w in distinct], np.uint64).tobytes(), "codes": lm.by_bytes(np.array([distinct.index(w) for w in flat], np.uint32))}
    c = lm.Chunk(row)
    counts = c.counts()
    a = lm.Automaton(c, counts, int(counts[0].sum()), 4, 0.1, [1.5, 0.7])
    last = 10 ** a.traverse(c.starts, c.sizes)[(c.starts + c.sizes - 1)[4:]]
    assert np.allclose(last.reshape(-1, 5).sum(1), 1)


def test_lm_empty(none):
    assert lm.score(none, queries.remainder(7)).collect() == []


def test_token_ids(odd, docs, spark):
    tok = Tokenizer.from_file(PATH)
    for df in (odd, docs):
        at = Scratch(spark, "ids").path("shards")
        manifest = tokenids.write(df, at, PATH, end_id=2, shard_ids=3000)
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenids.with_start(tokenids.read(spark, at), manifest).collect()]
        want, start = [], 0
        for i, t in sorted(rows_of(df), key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64))):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(got, key=lambda r: r[1]) == want
    keys = spark.createDataFrame([(3,), (5,), (10**15,)], "doc_id long")
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenids.fetch(spark, at, keys).collect()}
    text = dict(rows_of(docs))
    assert found == {i: [*tok.encode(text[i] or "", add_special_tokens=False).ids, 2] for i in (3, 5)}


def test_fetch_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(tokenids, "GROUP", 3)
    monkeypatch.setattr(tokenids, "BLOCK", 2)
    rows = [(7 * (k // 3), f"text number {k}") for k in range(900)] + [(700, f"many {k}") for k in range(200)] + [(None, "no id")] * 40
    at = Scratch(spark, "ids").path("shards")
    manifest = tokenids.write(spark.createDataFrame(rows, "doc_id long, text string"), at, PATH, end_id=2, shard_ids=60)
    got = tokenids.with_start(tokenids.read(spark, at), manifest).orderBy("start").collect()
    assert manifest.count() > 40 and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    keys = spark.createDataFrame([(k,) for k in [*range(-5, 2200), 700, None, 2**62]], "doc_id long")
    found = Counter((r.doc_id, zlib.crc32(r.ids)) for r in tokenids.fetch(spark, at, keys).collect())
    first = {}
    for r in got:
        if r.doc_id is not None:
            first.setdefault(r.doc_id, r.ids_crc32)
    assert found == Counter(first.items())


def test_token_ids_empty(none, spark):
    at = Scratch(spark, "ids").path("shards")
    manifest = tokenids.write(none, at, PATH, end_id=2)
    assert tokenids.with_start(tokenids.read(spark, at), manifest).collect() == []
    assert tokenids.fetch(spark, at, none).collect() == [] == tokenids.fetch(spark, at, spark.createDataFrame([(1,)], "doc_id long")).collect()


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000))
    mph = PerfectHash.build(keys)
    assert sorted(mph.find(keys)) == list(range(len(keys)))
    assert (mph.find(np.setdiff1d(np.arange(10_000), keys)) == -1).mean() > 0.999
    table = HashTable(keys.view(np.uint64))
    assert (table.find(keys.view(np.uint64)) == np.arange(len(keys))).all()


@pytest.mark.parametrize("table", ["odd", "docs", "none"])
def test_bpe(table, request):
    df = request.getfixturevalue(table)
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows_of(df):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)] += 1
    encoded = bpe.encode(df, PATH, decoded=True)
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in encoded.collect()) == want
    assert Counter((r.doc_id, r.text) for r in bpe.decode(encoded, PATH).collect()) == Counter((i, x) for (i, _, x), n in want.items() for _ in range(n))


def test_words_are_split_like_the_pattern():
    from lumaquery.llm import bytelevel

    rng = np.random.default_rng(2)
    signs = list("strevlmdxA9 .-") + ["'", "'", " ", "\n", "\t", "é", "\u3000", "日"]
    for _ in range(200):
        texts = ["".join(rng.choice(signs, rng.integers(1, 25))) for _ in range(20)]
        points = np.array([ord(x) for t in texts for x in t], np.uint32)
        sizes = np.array([len(t) for t in texts])
        first = np.zeros(len(points), bool)
        first[np.cumsum(sizes) - sizes] = True
        starts = np.flatnonzero(bytelevel.word_starts(points, first)).tolist()
        want, at = [], 0
        for t in texts:
            for w in bytelevel.split_slow(t):
                want.append(at)
                at += len(w)
        assert starts == want


def test_other_vocabularies_are_refused(tmp_path):
    import json

    from lumaquery.llm import bytelevel

    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        at = tmp_path / "v.json"
        at.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="not supported"):
            bytelevel.Vocabulary(str(at))
    bytelevel.Vocabulary(PATH)


def test_bpe_of_one_long_word(spark):
    tok = Tokenizer.from_file(PATH)
    texts = ["ab" * 20_000, "日本語" * 4000, "x'" * 5000, "it's we'll they've I'd o'clock 'tis rock'n'roll " * 50]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    assert all(got[i] == tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_bpe_decodes_broken_utf8():
    from lumaquery.llm.bytelevel import vocabulary

    tok, rng = Tokenizer.from_file(PATH), np.random.default_rng(5)
    for _ in range(300):
        ids = rng.integers(0, 400, rng.integers(0, 9))
        assert bpe.decode_ids(vocabulary(PATH), ids) == tok.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("table", ["odd", "docs", "none"])
def test_packing(table, request):
    df = request.getfixturevalue(table)
    tok = Tokenizer.from_file(PATH)
    want = Counter((i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows_of(df))
    pieces = packing.pack_documents(df, PATH).collect()
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append(p)
    padding = 0
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1].tolist()]
        size = sum(p.length for p in s)
        assert size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding == 0
    if table == "docs":  # ids are unique there
        whole = defaultdict(list)
        for p in pieces:
            whole[p.doc_id].append(p)
        got = Counter()
        for i, ps in whole.items():
            ps.sort(key=lambda p: p.start)
            assert [p.start for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1].tolist()]
            assert {p.doc_tokens for p in ps} == {sum(p.length for p in ps)}
            got[i, b"".join(bytes(p.ids) for p in ps)] += 1
        assert got == want
    else:
        assert sum(len(p.ids) for p in pieces) == sum(len(b) * n for (_, b), n in want.items())


def test_packing_puts_neighbours_together():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * t, 1000 * t + 150, (8, 500)) for t in range(4)]
    docs = [topics[t][k].astype(np.uint32) for k in range(8) for t in range(4)]
    sequences = defaultdict(set)
    for d, _, _, s, _ in packing.pack(docs):
        sequences[s].add(d % 4)
    assert np.mean([len(x) for x in sequences.values()]) < 2


def test_packing_scores_with_all_terms():
    rng = np.random.default_rng(4)
    common, rare = np.arange(1000, 1400), np.arange(5000, 5040)
    # the seed's 40 rarest terms lie in documents 1 and 2; document 3 shares 400 other terms
    docs = [np.concatenate([common, rare]), rare[:20], rare[20:], common, *(rng.choice(common, 150, replace=False) for _ in range(40))]
    docs = [d.astype(np.uint32) for d in docs]
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = Counter(t for d in docs for t in set(d.tolist()))

    def plain(seed):
        out = []
        for d in docs:
            norm = 1.2 * (0.25 + 0.75 * len(d) / mean)
            out.append(sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 * k / (k + norm) for t, k in Counter(d.tolist()).items() if t in seed))
        return np.array(out)

    index = packing.Index(docs)
    for k in (0, 3, 7):
        want = plain(set(docs[k].tolist()))
        used = np.zeros(n, bool)
        used[k] = True
        near = index.nearest(k, used)
        assert set(near.tolist()) == {d for d in range(n) if d != k and want[d] > 0}
        assert (np.diff(want[near]) < 1e-4).all()


def test_packing_brings_far_copies_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 60)) for _ in range(100)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k + 100, t + " more") for k, t in enumerate(texts)]
    monkeypatch.setattr(packing, "SHARD_IDS", 6000)
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id"), PATH).collect()
    sequences = defaultdict(set)
    for p in pieces:
        sequences[p.doc_id].add(p.sequence_id)
    # in scan order a document and its copy lie in different shards
    assert np.mean([bool(sequences[k] & sequences[k + 100]) for k in range(100)]) > 0.7


def test_packing_corpus_statistics():
    docs = [np.array(x, np.uint32) for x in ([1, 2, 2, 3], [2, 3], [3, 4, 4])]
    corpus = packing.Corpus(np.array([1, 2, 3, 4]), np.array([10, 500, 900, 3]), 1000, 7000)
    weight = {(int(index.terms[t]), int(index.doc[p])): index.weight[p] for index in [packing.Index(docs, corpus)] for t in range(4) for p in range(index.begin[t], index.end[t])}
    norm = 1.2 * (0.25 + 0.75 * 4 / 7)
    assert abs(weight[2, 0] - np.log1p((1000 - 500 + 0.5) / 500.5) * 2.2 * 2 / (2 + norm)) < 1e-9


def test_digest_queries(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tok = Tokenizer.from_file(PATH)
    for r in queries.op7_bpe(spark, sf_dir).collect():
        ids = np.array(tok.encode(docs[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_scratch_is_cleared(spark, docs):
    import os

    from lumaquery.llm import common

    lm.score(docs.limit(20), F.lit(False)).collect()
    folders = [x.removeprefix("file://") for x in common._folders]
    assert any(os.path.isdir(x) for x in folders)
    common.clear_scratch(spark)
    assert not any(os.path.isdir(x) for x in folders)


def test_cache_leaves_the_words_met_last(monkeypatch):
    """The cache began anew whenever it was full, so frequent words were encoded again and again."""
    monkeypatch.setattr(bytelevel, "CACHE_WORDS", 40)
    tok, made = Tokenizer.from_file(PATH), []

    def encode_words(words):
        made.extend(words)
        ids = [tok.encode(w, add_special_tokens=False).ids for w in words]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids])

    enc = bytelevel.WordEncoder(bytelevel.vocabulary(PATH), encode_words)
    texts = [" the same few words" + "".join(f" w{'abcdefghij'[k % 10]}{'xyzuvw'[k % 6]}{'klmnop'[n % 6]}q{chr(97 + n)}" for k in range(7)) for n in range(26)]
    for t in texts:
        assert next(enc.encode([t])).tolist() == tok.encode(t, add_special_tokens=False).ids
        assert len(enc.slot) <= 40 + 11
    assert Counter(made)[" same"] == 1 and len(made) > 120


def test_words_of_line_ends_and_last_bytes():
    """Ids by the library for words that hold line ends or the highest code points, all in one block."""
    words = ["a", "\n", " \n", "\n\n\n", "ÿ", " ÿÿ", "\U0010ffff", "é\n", " word"]
    tok = Tokenizer.from_file(PATH)
    ids, sizes = bytelevel.library_encoder(PATH).encode_words(words)
    want = [[t.id for t in tok.model.tokenize("".join(bytelevel.byte_chars()[0][b] for b in w.encode()))] for w in words]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_used_documents_leave_the_postings():
    """A shard's postings kept every used document, and all neighbours were put in order for every window."""
    rng = np.random.default_rng(11)
    docs = [rng.choice(300, int(k)).astype(np.uint32) for k in rng.integers(5, 400, 120)]
    index, plain = packing.Index(docs), packing.Index(docs)
    used = rng.random(120) < 0.5
    held = len(index.doc)
    index.drop(used)
    assert len(index.doc) < held and not used[index.doc].any()
    for seed in range(0, 120, 7):
        assert (index.scores(seed, used) == plain.scores(seed, used)).all()
        assert (index.nearest(seed, used) == plain.nearest(seed, used)).all()
