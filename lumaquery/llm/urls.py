"""URL filters: listed canonical URLs, found by a blocked Bloom filter and exact joins.

A list entry is a host and the beginning of a path, with an action.  It fits its
host and all subdomains where the path begins so; of several the longest counts.
The ends of a URL's host are tried first.  What a blocked Bloom filter (blocks of
four 64-bit words, a bit in each) of the listed hosts and entries lets pass is
joined with the listed hosts, which tells the lengths of the paths listed for each
host.  Beginnings of the URL's path of these lengths are tried likewise and joined
with the entries.  The exact joins remove the filter's false positives.

The filter is a table of blocks and is joined by block number, so it may be as long
as the list needs; up to a measured size (some 3 million entries) it is broadcast, so
that only what it lets pass is shuffled, beyond that it is joined by shuffle.
DataFrame operations only.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded

#: Bits of the filter for each key.
BITS = 16
WORDS = 4


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both empty for a null URL or one without ``://``."""
    url = F.col(url_col).cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    out = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    raw = F.regexp_extract("_rest", "^[^/?#]*", 0)
    out = out.withColumn("host", lower_ascii(raw)).withColumn("path", F.regexp_extract(F.substring(F.col("_rest"), F.length(raw) + 1, F.length("_rest")), "^[^?#]*", 0))
    return out.drop("_rest")


def host_ends(labels: int) -> Column:
    """Ends of up to ``labels`` labels of the host."""
    parts = F.slice(F.reverse(F.split("host", r"\.")), 1, labels)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.reverse(F.slice(parts, F.lit(1), n)), "."))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The key's block and its bit in each word of the block."""
    h = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [F.call_function("shiftleft", one, F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The filter of ``keys.key`` (``n`` of them) as rows of a block number and its words, and the number of blocks."""
    blocks = max(1, math.ceil(n * BITS / (64 * WORDS)))
    block, bits = _bits(F.col("key"), blocks)
    rows = keys.select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def passing(tried: DataFrame, key: Column, table: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key the filter lets pass: all listed ones and few others."""
    block, bits = _bits(key, blocks)
    hit = F.lit(True)
    for i, b in enumerate(bits):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    return tried.withColumn("block", block).join(table, "block").where(hit).drop("block", *[f"w{i}" for i in range(WORDS)])


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null without one) and ``verdict``.

    ``rules``: ``host``, ``path``, ``action``; hosts in lower case.  Equal entries
    with different actions count as ``block``.  A URL that no entry fits has the
    ``default``; so has every URL if the list is empty.  Columns of ``pages`` with
    the names of results are replaced.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    parted = with_parts(pages.drop("host", "path", "rule", "verdict"), url_col)
    whole = rules.where("host is not null and path is not null and action is not null").groupBy("host", "path").agg(F.max("action").alias("action"))  # block comes after allow
    listed = scratch.write(whole.select(F.concat("host", "path").alias("rule"), F.length("host").alias("_host"), "action", "host", "path"))
    n, labels = listed.agg(F.count("*"), F.max(F.size(F.split("host", r"\.")))).first()
    if not n:
        return parted.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    hosts = scratch.write(listed.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("_lengths")))
    entry = lambda host, path: F.concat_ws("\x00", host, path)
    keys = hosts.select(F.col("host").alias("key")).unionAll(listed.select(entry("host", "path").alias("key")))
    table, blocks = bloom(keys, 2 * n)
    table = bounded(scratch.write(table))
    tried = parted.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("_url"), "path", F.explode(host_ends(labels)).alias("_end"))
    tried = passing(tried, F.col("_end"), table, blocks).join(hosts.withColumnRenamed("host", "_end"), "_end")
    begins = F.transform(F.filter("_lengths", lambda k: k <= F.length("path")), lambda k: F.left("path", k))
    tried = tried.select("_url", "_end", F.explode(begins).alias("_begin"))
    entries = listed.select(F.col("host").alias("_end"), F.col("path").alias("_begin"), "rule", "_host", "action")
    hits = passing(tried, entry("_end", "_begin"), table, blocks).join(entries, ["_end", "_begin"])
    longest = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "_host"))
    best = scratch.write(hits.groupBy("_url").agg(longest.alias("b")).select("_url", "b.rule", F.col("b.action").alias("_action")))
    known = parted.where(F.col(url_col).isNotNull())
    # grows with the pages, so it is never broadcast
    out = known.join(best.hint("merge"), known[url_col] == best["_url"], "left").drop("_url")
    none = parted.where(F.col(url_col).isNull()).withColumn("rule", F.lit(None).cast("string")).withColumn("_action", F.lit(None).cast("string"))
    return out.unionByName(none).withColumn("verdict", F.coalesce("_action", F.lit(default))).drop("_action")
