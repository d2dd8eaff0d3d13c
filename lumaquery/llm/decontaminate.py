"""Benchmark decontamination: documents that hold word windows of test items.

Texts are lower-cased (A-Z only) and cut into words of letters and digits.  An
item's windows are its runs of ten words; an item of fewer words is one window.
The windows' hashes are a set that is broadcast where its measured size allows
it.  Every window of every document is looked up in it; a hit counts once the
words themselves are equal.  A document's words inside any hit are marked, and
its hit spans or the whole document can be removed.

Windows that lie in the same items share one entry of items, so a passage of many
windows costs a row for each document, not for each window and item.  Verdicts are
made for distinct texts, so copies are pre-aggregated in each task.  DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, text_column
from .urls import lower_ascii

WINDOW = 10
#: What separates words: ASCII other than letters and digits (after A-Z are lower-cased, or before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """The words of a text; of a null text null."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _hash(hashes: str, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + k) for k in range(n)])


def _text(array: str, at: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(array, at + k) for k in range(n)])


def _places(n: Column, length: int) -> Column:
    """Where windows of that length begin in n words."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _hashes(n: Column, length: int) -> Column:
    return F.transform(_places(n, length), lambda at: _hash("hashes", at, length))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``length``, ``h``, ``gram`` and ``items`` (sorted ids as strings) of every distinct window of the items."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(text_column(benchmark, text_col)).alias("w"))
    items = items.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n", F.size("w")).where("n > 0")
    parts = []
    for length in range(1, window + 1):
        own = items.where(F.col("n") >= length) if length == window else items.where(F.col("n") == length)
        own = own.select("item", "w", "hashes", F.explode(_places(F.col("n"), length)).alias("at"))
        parts.append(own.select("item", F.lit(length).alias("length"), _hash("hashes", F.col("at"), length).alias("h"), _text("w", F.col("at"), length).alias("gram")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("length", "h", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, windows: DataFrame, lengths: list[int], text_col: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``_key`` (of the text), ``at``, ``length`` and ``items_id`` of every window of the documents that is an item's.

    ``windows``: a written table of ``length``, ``h``, ``gram``, ``items_id``.  Up to ``limit`` bytes of
    it are broadcast; beyond that the documents' windows are dealt by hash.
    """
    text = text_column(docs, text_col)
    rows = docs.select(F.md5(text).alias("_key"), words(text).alias("w")).withColumns({"n": F.size("w"), "hashes": F.transform("w", lambda x: F.xxhash64(x))})
    every = F.concat(*[_hashes(F.col("n"), k) for k in lengths])
    # "outer", as Spark would else look for empty arrays in the scan and make them all there
    rows = rows.select("_key", "w", "n", every.alias("every")).select("_key", "w", "n", F.posexplode_outer("every").alias("place", "own"))
    # the windows of each length follow those of the one before
    begin, at, gram = F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("string")
    for k in lengths:
        here = F.col("place") >= begin
        at, gram = F.when(here, F.col("place") - begin).otherwise(at), F.when(here, _text("w", F.col("place") - begin, k)).otherwise(gram)
        begin = begin + F.greatest(F.col("n") - k + 1, F.lit(0))
    held = windows.agg(F.sum(F.octet_length("gram") + F.octet_length("items_id") + 12)).first()[0] or 0
    if held <= limit:  # words are compared where hashes are equal; as two bounds, else they would be a key made for every window
        found = rows.join(F.broadcast(windows), (F.col("own") == F.col("h")) & (gram >= F.col("gram")) & (gram <= F.col("gram")))
        return found.select("_key", at.alias("at"), "length", "items_id")
    # a window's words go with it, not its document's
    own = rows.select("_key", at.alias("at"), "own", gram.alias("own_gram")).where("own is not null")
    found = own.join(windows.hint("merge"), (F.col("own") == F.col("h")) & (F.col("own_gram") == F.col("gram")))
    return found.select("_key", "at", "length", "items_id")


def verdicts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``_key`` (md5 of the text), ``spans`` (sorted, disjoint runs of hit words, from and to), ``n_hit`` and ``items``
    of every distinct text with a hit, as a written table."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = scratch.write(item_windows(benchmark, item_col, item_text, window))
    shared = F.md5(F.array_join("items", "\x00")).alias("items_id")
    windows = scratch.write(found.select("length", "h", "gram", shared))
    sets = scratch.write(found.select(shared, "items").dropDuplicates(["items_id"]))
    lengths = [r[0] for r in windows.select("length").distinct().orderBy("length").collect()]  # at most ``window`` of them
    if not lengths:
        return docs.sparkSession.createDataFrame([], "_key string, spans array<struct<from: int, to: int>>, n_hit long, items array<string>")
    hit = hits(docs, windows, lengths, text_col, limit)
    hit = scratch.write(hit.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("at", "length"))).alias("places"), F.collect_set("items_id").alias("sets")))
    # a place that begins within the last run or at its end makes it longer
    run = lambda a, b: F.struct(a.cast("int").alias("from"), b.cast("int").alias("to"))
    last = lambda runs: F.element_at(runs, -1)
    start = F.array().cast("array<struct<from: int, to: int>>")

    def grown(runs: Column, x: Column) -> Column:
        end = x["at"] + x["length"]
        head = F.slice(runs, F.lit(1), F.size(runs) - 1)
        return F.when((F.size(runs) > 0) & (F.get(runs, F.size(runs) - 1)["to"] >= x["at"]), F.concat(head, F.array(run(last(runs)["from"], F.greatest(last(runs)["to"], end))))).otherwise(F.concat(runs, F.array(run(x["at"], end))))

    spans = hit.select("_key", F.aggregate("places", start, grown).alias("spans"))
    items = hit.select("_key", F.explode("sets").alias("items_id")).join(bounded_sets(sets, limit), "items_id")
    items = items.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return scratch.write(spans.join(items, "_key").select("_key", "spans", n_hit.alias("n_hit"), "items"))


def bounded_sets(sets: DataFrame, limit: int) -> DataFrame:
    """The sets of items, marked for broadcast if their content is at most ``limit`` bytes."""
    held = sets.agg(F.sum(F.octet_length(F.array_join("items", ",")) + 40)).first()[0] or 0
    return F.broadcast(sets) if held <= limit else sets


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids as strings), ``spans`` and ``contaminated``.

    Null and empty texts, and those without letters or digits, have no words and no hits; so has every
    document if no item has a word.  Items without an id hit words but are in no list; rows of the same
    item id are one item with the windows of all its texts.  Rows of equal or null document ids are
    judged each.  Columns of ``docs`` with the names of results are replaced, other columns stay.
    ``options``: those of ``verdicts``.
    """
    found = verdicts(docs, benchmark, text_col, **options)
    results = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
    rows = docs.drop(*[c for c in results if c != text_col])
    n_words = F.regexp_count(text_column(docs, text_col), F.lit(LETTERS + "+")).cast("long")
    rows = rows.withColumn("n_words", n_words).withColumn("_key", F.md5(text_column(docs, text_col)))
    held = found.agg(F.sum(F.octet_length("_key") + 8 * F.size("spans") + F.octet_length(F.array_join("items", ",")))).first()[0] or 0
    out = rows.join(F.broadcast(found) if held <= BROADCAST_BYTES else found.hint("merge"), "_key", "left").drop("_key")
    none = F.array().cast("array<string>")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none), "spans": F.coalesce("spans", F.array().cast("array<struct<from: int, to: int>>"))})
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def clean(docs: DataFrame, benchmark: DataFrame, spans: bool = False, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with ``spans`` all of them without their hit runs of words.

    A run goes from its first word's first character to its last word's last; what is around it stays.
    Columns keep their names and order, whatever these are.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("_row"), text_column(docs, text_col).alias("_text"))
    found = scan(rows, benchmark, "_text", **options)
    if not spans:
        return found.where("not contaminated").select("_row.*")
    # words and what is between them in turn; word k is piece 2 k, or 2 k + 1 where the text begins otherwise
    pieces = F.regexp_extract_all("_text", F.lit(rf"{LETTERS}+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    step = found.withColumn("_pieces", F.when(F.col("contaminated"), pieces)).withColumn("_first", F.when(F.col("_text").rlike(f"^{LETTERS}"), 0).otherwise(1))
    goes = lambda i: F.exists("spans", lambda s: (i >= 2 * s["from"] + F.col("_first")) & (i <= 2 * (s["to"] - 1) + F.col("_first")))
    left = F.array_join(F.transform(F.filter(F.transform("_pieces", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~goes(p["i"])), lambda p: p["x"]), "")
    text = F.when(F.col("contaminated"), left).otherwise(F.col("_row")[text_col])
    return step.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
