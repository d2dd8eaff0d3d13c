"""Very long texts, and tables in which every row has the same id."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumaquery.llm import bpe, lm, packing, quality, queries, simhash, urls

LONG = [" ".join(f"w{(k * k) % 9973}" for k in range(300_000)), "x" * 1_500_000, "a b\n" * 200_000]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(i, t, "en", "web") for i, t in enumerate([*LONG, LONG[0] + " more words", "a short text of a few words", None])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def one_id(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "quite another text with other words in it", "", None, "a b c"] * 5
    return spark.createDataFrame([(7, t, "en", "web") for t in texts], "doc_id long, text string, lang string, source string")


def test_simhash(long, one_id):
    got = {r.doc_id: r for r in simhash.components(long).collect()}
    assert len(got) == 6 and got[5].fp == 0
    assert all(got[i].fp & (2**64 - 1) == simhash.fingerprint(t) for i, t in enumerate(LONG)) and got[3].component_id == 0
    same = simhash.components(one_id).collect()
    assert len(same) == 30 and {r.component_id for r in same} == {7} and len({r.fp for r in same}) == 4


def test_near_duplicates(long, one_id):
    kept = simhash.deduplicate(long).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2, 4, 5] and {r.doc_id: r.text for r in kept}[0] == LONG[0]
    left = simhash.deduplicate(one_id).collect()
    assert len(left) == 1 and left[0].doc_id == 7 and not left[0].text  # of one id the smallest text stays


def test_lm(long, one_id):
    for df, n in ((long, 6), (one_id, 30)):
        out = lm.score(df, F.lit(False)).collect()
        assert len(out) == n and all(r.score < 0 and r.base_score < 0 and r.n_known == r.n_tokens for r in out)
    got = {r.doc_id: r for r in lm.score(long, F.col("doc_id") == 3).collect()}
    assert got[0].n_tokens == 300_001 and got[1].n_tokens == 2 and got[5].n_tokens == 1 and got[3].n_known == 300_003 - 1


def test_quality(long, one_id):
    got = {r.doc_id: r for r in quality.judge(long).collect()}
    assert [got[i].n_words for i in range(6)] == [300_000, 1, 400_000, 300_002, 7, 0]
    assert got[2].n_dup_lines == 199_999 and got[2].n_repeat_words == 400_000 and got[2].base_failed and not got[2].kept
    out = quality.judge(one_id).collect()
    assert len(out) == 30 and Counter(r.n_words for r in out) == {7: 10, 8: 5, 0: 10, 3: 5} and all(r.base_failed for r in out)


def test_packing(long, one_id):
    plain = Tokenizer.from_file(queries.tokenizer_path())
    for df, every in ((long, [*LONG, LONG[0] + " more words", "a short text of a few words", ""]), (one_id, None)):
        out = packing.pack_documents(df, queries.tokenizer_path(), end_id=1).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
        spans: dict = {}
        for r in out:
            spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in spans.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at and length > 0
                at += length
            assert at <= 2048
        if every:
            for i, t in enumerate(every):
                n = len(plain.encode(t, add_special_tokens=False).ids) + 1
                mine = sorted((r.start, r.length) for r in out if r.doc_id == i)
                assert all(r.doc_tokens == n for r in out if r.doc_id == i)
                assert mine[0][0] == 0 and sum(x for _, x in mine) == n and all(a + b == c for (a, b), (c, _) in zip(mine, mine[1:], strict=False))
        else:
            assert sum(r.length for r in out) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for (t,) in one_id.select("text").collect())


def test_bpe_round_trip(long):
    out = {r.doc_id: r for r in bpe.encode(long, queries.tokenizer_path(), decoded=True).collect()}
    assert all(out[i].decoded == t for i, t in enumerate(LONG)) and out[5].decoded == ""
    assert zlib.crc32(out[5].ids) == 0


def test_long_urls(spark):
    rows = [(1, "http://" + "a." * 3000 + "example.com/en/" + "x/" * 50_000), (2, "http://example.com/en/" + "y" * 200_000), (3, "http://" + "z" * 100_000)]
    rules = spark.createDataFrame([("example.com", "/en/", "block"), ("example.com", "/en/" + "y" * 150_000, "allow")], "host string, path string, action string")
    got = {r.page_id: (r.rule and len(r.rule), r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {1: (15, "block"), 2: (150_015, "allow"), 3: (None, "allow")}
