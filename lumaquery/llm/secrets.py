"""Secret scans with a random forest against false positives, in DataFrame operations only.

A candidate is a run of at least 16 token characters with a digit in it, or what
stands after a secret's name and a sign of assignment (at least 8 signs without
white space, digits or not, dots included), or a URL's password (at least 8 signs
between the user's name and the ``@``).  Its features are its length, its
kinds of characters, how likely its transitions between classes of characters are
among secrets and among look-alikes (a table counted from the labelled findings),
how much of it words cover (those counted in the corpus and some fixed ones), the
document's path (its source), and the words before and after it.  A random
forest, trained from labelled findings, gives the probability that the candidate
is a secret; its trees become one expression, so scanning needs no join and no
shuffle, and a row's candidates stay with its row.

A secret that is shorter than 16 characters or without a digit is found beside a
name only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_column

#: Names beside which secrets stand, names beside which look-alikes stand,
#: paths of examples, and words that made-up values are written with.
SECRET_NAMES = "token|passw|pwd|secret|api[_-]?key|auth|bearer|credential|access[_-]?key|private"
OTHER_NAMES = "commit|sha|uuid|guid|hash|md5|etag|version|revision|checksum|digest|isbn|order|invoice|session|page|file|image|object|integrity|base64|sum|ref|src|path"
EXAMPLES = "test|example|sample|mock|fixture|doc"
DICTIONARY = "example|sample|placeholder|change|your|here|test|user|name|token|secret|password|admin|default|index|image|file|page|data|value|order|session|customer|service|server|client|config|backup|release|version|build|report|account|update|string|number|object|request|response|handler|manager|required|optional|header|the|and|for|get|set|key|api|url|id"
#: Runs of token characters, and values after a secret's name.
VALUE = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}"
NAME = rf"(?:(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{{0,64}}?(?i:{SECRET_NAMES})[A-Za-z0-9_\-]{{0,32}}[\"']{{0,2}}[\x20\t]{{0,3}}[:=][\x20\t]{{0,3}}[\"']?|(?<![A-Za-z0-9_\-])(?i:bearer)[\x20\t]{{1,3}})"
#: A URL's user before a password, with what a password consists of.
_PASSWORD = r"[^\x20\x09-\x0D\"'<>@/]{8,128}"
USER = rf"[A-Za-z0-9._%+\-]{{1,64}}:(?={_PASSWORD}@)"
NAMED = rf"(?<=://){USER}{_PASSWORD}|{NAME}" + r"[^\x20\x09-\x0D\"'<>,;&]{8,}"
CANDIDATE = f"{NAMED}|{VALUE}"
#: A document without a match of either holds no candidate.
ANY = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}"
#: Characters that are looked at before and after a candidate, and gaps without a letter
#: that are looked over for what stands before it.
BEFORE, AFTER, LOOK_BACK = 48, 24, 4
#: Words of the corpus that make its dictionary: those that are at least this share of all its words,
#: so there are 4000 of them at most, and as many for any size of the corpus.
DICTIONARY_SHARE = 1 / 4000
THRESHOLD = 0.5
MASK = "<SECRET>"
TREES, DEPTH, TRAINING_ROWS, SEED = 20, 6, 4000, 7
FEATURES = ["length", "digits", "capitals", "transitions", "distinct", "hexadecimal", "run", "dictionary", "separators", "example_path", "secret_name", "other_name", "assigned", "quoted", "other_after", "segments", "marked"]
#: How digests are marked, and data in URLs.
MARKS = "sha[0-9]+|md5|blake2|base64|crc"
#: The class of each character; other characters have class "o".
CLASSES = {"d": "0123456789", "h": "bcdf", "v": "aeiouy", "c": "ghjklmnpqrstvwxz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "s": "+/_-", "p": ".:=$@!%"}
_ARRAY = "array<struct<value:string,before:string,after:string>>"


def candidates(text: Column) -> Column:
    """The candidates of a text in order: their value and what stands before and after.

    Before stand up to ``BEFORE`` characters since the candidate before; where these hold no
    letter (in a list of values), also what stands before that one.
    """
    assigned = text.contains("=") | text.contains(":") | text.rlike("(?i)bearer")
    some = (text.rlike("[0-9]") & text.rlike(ANY)) | (assigned & text.rlike(NAMED))
    parts = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("m"), F.split(text, CANDIDATE, -1).alias("g"))
    # arguments of lambdas are computed once
    found = F.transform(F.array(parts), lambda p: F.transform(p["m"], lambda m, k: _split(m, F.get(p["g"], k), F.get(p["g"], k + 1))))[0]
    chained = F.transform(F.array(found), lambda f: F.filter(F.transform(f, lambda c, k: _with_context(f, c, k)), lambda c: c.isNotNull()))[0]
    return F.when(some, chained).otherwise(F.array().cast(_ARRAY))


def _split(match: Column, gap: Column, after: Column) -> Column:
    """A match as its value, the text on its left and the text on its right."""
    name = F.regexp_extract(F.concat(match, F.left(after, F.lit(1))), f"^(?:{USER}|{NAME})", 0)
    whole = F.substring(match, F.length(name) + 1, F.length(match))
    value = F.when(F.length(name) > 0, F.regexp_replace(whole, r"[.)\]};:!?*$#%&]+$", "")).otherwise(whole)
    rest = F.substring(whole, F.length(value) + 1, F.length(whole))
    return F.struct(value.alias("value"), F.concat(F.right(gap, F.lit(BEFORE)), name).alias("left"), F.left(F.concat(rest, after), F.lit(AFTER)).alias("after"), (F.length(name) > 0).alias("named"))


def _with_context(found: Column, c: Column, k: Column) -> Column:
    """The candidate with its context, null for a match that is none."""
    lefts = [F.get(found, k - d)["left"] for d in range(LOOK_BACK + 1)]
    chains = [F.concat_ws("", *lefts[d::-1]) for d in range(LOOK_BACK + 1)]
    before = chains[-1]
    for left, chain in zip(lefts[-2::-1], chains[-2::-1], strict=True):
        before = F.when(left.rlike(r"\p{L}"), chain).otherwise(before)
    fits = (c["named"] & (F.length(c["value"]) >= 8)) | (c["value"].rlike("[0-9]") & (F.length(c["value"]) >= 16))
    return F.when(fits, F.struct(c["value"].alias("value"), before.alias("before"), c["after"].alias("after")))


def classes(value: Column) -> Column:
    """The value with each character's class in its place."""
    known = F.regexp_replace(value, r"[^A-Za-z0-9+/_\-.:=$@!%]", "~")
    return F.translate(known, "".join(CLASSES.values()) + "~", "".join(k * len(v) for k, v in CLASSES.items()) + "o")


def transitions(value: Column) -> Column:
    """Pairs of classes of neighbouring characters."""
    return F.transform(F.array(classes(value)), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))[0]


def corpus_words(docs: DataFrame, share: float = DICTIONARY_SHARE, text_col: str = "text") -> list[str]:
    """The words of 4 to 16 letters that are at least ``share`` of the words of all whole texts, in lower case and order."""
    words = docs.select(F.explode(F.split(F.lower(text_column(docs, text_col)), r"[^\p{L}\p{Nd}]+")).alias("word"))
    words = words.where(F.length("word").between(4, 16)).groupBy("word").count().where(~F.col("word").rlike(r"\p{Nd}"))
    words = Scratch(docs.sparkSession, "words").write(words)
    total = words.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return sorted(r[0] for r in words.where(F.col("count") >= share * total).collect())  # 1 / share at most


class Model:
    """What scanning needs: the table of transitions, the dictionary and the forest."""

    def __init__(self, table: dict[str, float], words: list[str], trees: list | None = None):
        self.table, self.words, self.trees = table, [w for w in words if len(w) >= 4], trees or []

    def features(self, c: Column, path: Column) -> list[Column]:
        """The features of a candidate, in the order of ``FEATURES``."""
        v, before, after = c["value"], F.lower(c["before"]), F.lower(c["after"])
        n = F.length(v).cast("double")
        share = lambda pattern: F.size(F.regexp_extract_all(v, F.lit(pattern), F.lit(0))) / n
        flag = lambda x: x.cast("double")
        table = F.create_map(*[F.lit(x) for pair in sorted(self.table.items()) for x in pair]) if self.table else F.lit(None).cast("map<string,double>")
        weighed = F.aggregate(transitions(v), F.lit(0.0), lambda a, p: a + F.coalesce(F.element_at(table, p), F.lit(0.0)))
        pieces = F.split(F.lower(F.regexp_replace(v, r"(\p{Ll})(\p{Lu})", "$1 $2")), r"[^\p{L}]+")
        known = F.aggregate(F.filter(pieces, lambda p: p.isin(self.words)), F.lit(0), lambda a, p: a + F.length(p)) / n if self.words else F.lit(0.0)
        fixed = (n - F.length(F.regexp_replace(F.lower(v), f"({DICTIONARY})", ""))) / n
        return [
            n,
            share("[0-9]"),
            share("[A-Z]"),
            weighed / F.greatest(n - 1, F.lit(1.0)),
            F.size(F.array_distinct(F.split(v, ""))) / n,
            flag(v.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
            flag(v.rlike(r"(.)\1{4,}")),
            F.greatest(known, fixed),
            share(r"[+/_\-.:]"),
            flag(F.coalesce(F.lower(path), F.lit("")).rlike(EXAMPLES)),
            flag(before.rlike(f"{SECRET_NAMES}|://[^/@ ]*:$")),
            flag(before.rlike(f"({OTHER_NAMES})")),
            flag(before.rlike("[=:]\\s*[\"']?$")),
            flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
            flag(after.rlike(f"{OTHER_NAMES}|{EXAMPLES}")),
            # letters in whole words between separators, as in paths and names
            F.length(F.array_join(F.regexp_extract_all(v, F.lit("(?<![A-Za-z0-9])[A-Z]?[a-z]{2,}(?:[A-Z][a-z]+)*(?![A-Za-z0-9])"), F.lit(0)), "")) / n,
            flag(v.rlike(f"(?i)^({MARKS})[\\-:_]") | before.rlike(f"({MARKS})[,:\\- ]*$")),
        ]

    def probability(self, x: list[str]) -> str:
        """The forest's probability over features named in SQL: the mean over trees of the share of secrets in the leaf."""

        def value(node) -> str:
            return f"{node!r}D" if isinstance(node, float) else f"CASE WHEN {x[node[0]]} <= {float(node[1])!r}D THEN {value(node[2])} ELSE {value(node[3])} END"

        return f"({' + '.join(value(t) for t in self.trees)}) / {len(self.trees)}"


def saved_trees(spark: SparkSession, path: str) -> list:
    """The trees of a saved forest as nested (feature, threshold, below, above); a leaf is its share of label 1."""
    nodes: dict[int, dict] = defaultdict(dict)
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # trees times 2 ** depth at most
        nodes[r["treeID"]][r["id"]] = r

    def grow(tree: dict, at: int):
        r = tree[at]
        if r["leftChild"] < 0:
            return float(r["impurityStats"][1] / sum(r["impurityStats"]))
        return r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0], grow(tree, r["leftChild"]), grow(tree, r["rightChild"])

    return [grow(tree, 0) for _, tree in sorted(nodes.items())]


def fit(findings: DataFrame, words: list[str] = (), trees: int = TREES, depth: int = DEPTH) -> Model:
    """Train from labelled findings (``value``, ``before``, ``after``, ``path``, ``secret``).

    A null value, context or path counts as empty; findings without a value or a label
    are left out.  Findings of one label only, or none, give a model of that label's
    share (0 without findings).
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = findings.sparkSession
    scratch = Scratch(spark, "secrets")
    f = findings.where("secret is not null").select(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("value", "before", "after")]).alias("c"), F.coalesce("path", F.lit("")).alias("path"), F.col("secret").cast("double").alias("label"))
    f = scratch.write(f.where(F.length("c.value") > 0))
    counts = f.select("label", F.explode(transitions(F.col("c.value"))).alias("pair")).groupBy("pair").agg(F.count_if(F.col("label") > 0.5).alias("secret"), F.count_if(F.col("label") <= 0.5).alias("other")).collect()
    totals = [sum(r[k] for r in counts) + (len(CLASSES) + 1) ** 2 for k in ("secret", "other")]
    table = {r["pair"]: math.log((r["secret"] + 1) / totals[0]) - math.log((r["other"] + 1) / totals[1]) for r in counts}
    model = Model(table, list(words))
    share = f.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    if share in (0.0, 1.0):
        model.trees = [share]
        return model
    rows = f.select("label", *[x.alias(n) for n, x in zip(FEATURES, model.features(F.col("c"), F.col("path")), strict=True)])
    rows = scratch.write(rows)  # training reads them several times
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)
    path = scratch.path("forest")
    forest.write().save(path)
    model.trees = saved_trees(spark, path)
    for written in (f, rows):
        scratch.drop(written)
    return model


def train(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text") -> Model:
    """The model for ``docs``: their words as dictionary; without ``findings`` of a user's own, made-up ones."""
    words = corpus_words(docs, text_col=text_col)
    return fit(labelled_findings(docs.sparkSession, words=words) if findings is None else findings, words)


def scan(docs: DataFrame, model: Model, text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``_candidates`` (value, before, after, probability) and ``_secrets`` (distinct values).

    Null and empty texts have none.  Without the path column the path is empty.
    """
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")
    out = docs.withColumn("_found", candidates(text_column(docs, text_col)))
    # a candidate's features are an array first, so that the trees don't compute them again and again
    weighed = F.transform("_found", lambda c: F.struct(c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"), F.array(*model.features(c, path)).alias("x")))
    out = out.withColumn("_weighed", weighed)
    probability = model.probability([f"c.x[{i}]" for i in range(len(FEATURES))])
    out = out.withColumn("_candidates", F.expr(f"transform(_weighed, c -> struct(c.value AS value, c.before AS before, c.after AS after, {probability} AS probability))"))
    secrets = F.transform(F.filter("_candidates", lambda c: c["probability"] >= threshold), lambda c: c["value"])
    return out.withColumn("_secrets", F.array_distinct(secrets)).drop("_found", "_weighed")


def redact(scanned: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """Each secret's value replaced in the text, longer values first; texts without secrets stay as they are."""
    longest = F.sort_array(F.transform("_secrets", lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    text = F.col(text_col)
    clean = F.aggregate(longest, text, lambda t, s: F.replace(t, s["v"], F.lit(mask)))
    return scanned.withColumn(text_col, F.when(F.size("_secrets") > 0, clean).otherwise(text)).drop("_secrets", "_candidates")


def clean(docs: DataFrame, model: Model, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with its secrets replaced by the mask and its own columns, whatever their names; every row stays."""
    rest = [c for c in docs.columns if c != text_col]
    path = F.col(f"`{path_col}`").cast("string") if path_col in docs.columns else F.lit("")
    rows = docs.select(F.struct(F.lit(0), *[f"`{c}`" for c in rest]).alias("_row"), F.col(f"`{text_col}`").alias("text"), path.alias("source"))
    out = redact(scan(rows, model))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def labelled_findings(spark: SparkSession, n: int = TRAINING_ROWS, words: list[str] = ()) -> DataFrame:
    """Findings with their labels (``value``, ``before``, ``after``, ``path``, ``secret``) to train from
    where a user has none of their own: ``n`` made from digests, so always the same for the same ``words``."""
    draw = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("int")
    hexes = lambda size, salt: F.substring(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512), 1, size)
    mixed = lambda size, salt: F.substring(F.regexp_replace(F.base64(F.unhex(hexes(96, salt))), "=", ""), 1, size)
    pick = lambda options, salt: F.get(F.split(F.lit("\n".join(options)), "\n"), draw(salt, len(options)))
    cut = lambda value, low, high, salt: F.substring(value, F.lit(1), draw(salt, high - low + 1) + low)
    letters = F.regexp_replace(mixed(60, "l"), "[^A-Za-z]", "")
    every = [*DICTIONARY.split("|"), *[w for w in words if len(w) >= 4]]
    joined = lambda sep, salt, k=3: F.concat_ws(sep, *[pick(every, f"{salt}{i}") for i in range(k)])
    quoted, bare = ["token = \"", "PASSWORD = '", "api_key: \"", "secret=\"", "auth_token = '"], ["password=", "secret: ", "api_key=", "auth_token: ", "bearer ", "access_key=", "pwd=", "passwd: ", "token="]
    other = ["commit ", "sha1 ", "uuid ", "etag: ", "checksum = ", "version ", "order ", "file ", "md5: ", "page ", "session ", "revision "]
    plain = ["", "see ", "the ", "von ", "le ", "el ", "and ", *[f"{w} " for w in list(words)[:40]]]
    named = [*quoted, *bare]
    special = F.concat(cut(letters, 4, 7, "s"), pick(list("!@$%.:"), "t"), hexes(3, "u"), cut(mixed(30, "v"), 2, 6, "w"))
    either = lambda value, salt: F.when(draw(salt, 4) == 0, F.upper(value)).otherwise(value)
    secret = [
        (either(hexes(40, "a"), "A"), named),
        (either(cut(hexes(64, "b"), 16, 64, "B"), "C"), named),
        (cut(mixed(60, "c"), 16, 60, "D"), named),
        (cut(mixed(30, "d"), 8, 15, "E"), named),
        (cut(letters, 9, 24, "F"), named),
        (special, named),
        (F.concat_ws(".", mixed(20, "e"), mixed(36, "f"), mixed(27, "g")), [*named, "bearer "]),
        (F.concat(F.lit("AKIA"), F.upper(cut(mixed(40, "h"), 16, 16, "G"))), named + plain),
        (F.concat(F.lit("ghp_"), mixed(36, "i")), named + plain),
    ]
    false = [
        (either(hexes(40, "j"), "H"), other),
        (F.concat_ws("-", hexes(8, "k"), hexes(4, "m"), hexes(4, "n"), hexes(4, "o"), hexes(12, "p")), other + plain),
        (F.rpad(F.concat(joined("_", "q"), F.lit("_0")), 18, "0"), named + plain),
        (F.rpad(joined("-", "r"), 18, "1"), plain),
        (F.rpad(joined("/", "x"), 18, "2"), plain),
        (joined("_", "y"), named),
        (joined(".", "z", 2), bare),
        (F.rpad(pick(every, "1"), 8, "s"), named),
        (F.concat(F.lit("${"), F.upper(joined("_", "2", 2)), F.lit("}")), named),
        (F.regexp_replace(hexes(16, "3"), "[a-f]", "4"), plain + other),
        (F.regexp_replace(cut(hexes(40, "4"), 16, 40, "I"), "[a-f]", "7"), plain + other),
        (F.concat(F.repeat(F.lit("x"), 14), hexes(4, "5")), named),
        (F.repeat(pick(list("x*."), "6"), 12), named),
        (F.concat(F.lit("your_api_key_here_"), hexes(2, "7")), named),
        (hexes(32, "8"), other + plain),
    ]
    user = ["postgres://admin:", "https://deploy:", "amqp://svc:", "mongodb://root:", "redis://default:"]
    code = "src main lib core java scala util test include vendor node modules assets static public internal pkg cmd site packages".split()
    folder = lambda salt, k: F.concat_ws("/", *[F.when(draw(f"{salt}{i}", 3) == 0, pick(every, f"{salt}w{i}")).otherwise(pick(code, f"{salt}{i}")) for i in range(k)])
    secret += [
        (special, user),
        (cut(mixed(40, "L"), 10, 32, "M"), user),
        (cut(hexes(48, "N"), 12, 40, "O"), user),
        (either(cut(hexes(64, "P"), 24, 64, "Q"), "R"), ["export TOKEN=", "\"password\":\"", "\"client_secret\": \"", "Authorization: Bearer ", "--token=", "DB_PASSWORD="]),
        (cut(mixed(70, "S"), 20, 64, "T"), ["export API_KEY=", "\"auth_token\":\"", "\"secret\": \"", "Authorization: Bearer ", "--password=", "aws_secret_access_key = "]),
    ]
    false += [
        (F.concat(pick(["sha512-", "sha256-", "sha1-", "sha384-"], "U"), mixed(60, "V")), ["integrity ", "integrity: ", "\"integrity\": \"", "h1:", "resolved ", *plain]),
        (mixed(86, "W"), ["integrity sha512:", "checksum sha256:", "sha512:", "go.sum h1:", "digest: sha384:"]),
        (cut(mixed(120, "X"), 40, 110, "Y"), ["data:image/png;base64,", "url(data:font/woff2;base64,", "src=\"data:image/gif;base64,", "image base64:"]),
        (F.concat(folder("Z", 4), F.lit("/"), F.initcap(pick(every, "ZA")), F.upper(hexes(1, "ZB")), F.lpad(draw("ZC", 9999).cast("string"), 4, "0")), [*plain, "file ", "at ", "import ", "/", "path: "]),
        (F.concat(F.lit("/"), folder("ZD", 3), F.lit("/"), pick(every, "ZE"), F.lit("-"), draw("ZF", 99).cast("string"), F.lit("/"), pick(every, "ZG")), [*plain, "path = \"", "src=\"", "key = \"", "include "]),
        (cut(hexes(64, "ZH"), 32, 64, "ZI"), ["sha256:", "\"digest\": \"sha256:", "image@sha256:", "md5 = ", "tree ", "blob ", "ref: ", "etag: \""]),
    ]
    kinds = [*((v, b, 1.0) for v, b in secret for _ in range(2)), *((v, b, 0.0) for v, b in false)]
    ids = spark.range(0, n, 1, max(1, n // 20_000)).withColumn("kind", draw("kind", len(kinds)))
    made = [ids.where(F.col("kind") == k).select("id", v.alias("value"), pick(b, "b").alias("before"), F.lit(y).alias("secret")) for k, (v, b, y) in enumerate(kinds)]
    rows = reduce(DataFrame.unionAll, made)
    # what encloses a value closes after it; made-up values lie in examples more often, and what they are is said after them
    close = F.regexp_extract("before", "[\"']$", 0)
    true = F.col("secret") > 0.5
    after = F.when(~true & (draw("after", 5) == 0), F.concat(F.lit(" # "), pick([*EXAMPLES.split("|"), "checksum", "version"], "9"))).otherwise(F.concat(F.lit(" "), pick(plain, "0")))
    lead = F.when(draw("lead", 2) == 0, F.concat(pick(plain, "J"), F.lit(" "))).otherwise("")
    path = F.when(F.when(true, draw("path", 10) == 0).otherwise(draw("path", 10) < 4), pick(["src/example", "tests/mock", "docs/sample"], "K")).otherwise(F.concat(F.lit("src"), draw("dir", 20).cast("string")))
    return rows.select("value", F.concat(lead, "before").alias("before"), F.concat(close, after).alias("after"), path.alias("path"), "secret")
