"""Recall and false positives of the secret scan by kind, on findings made apart from the training ones."""

import base64
import random
import string

import pytest

from lumaquery.llm import secrets

ALNUM = string.ascii_letters + string.digits


def kinds():
    r = random.Random(41)
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    b64 = lambda n: base64.b64encode(r.randbytes(n)).decode()
    word = lambda: r.choice("network parser renderer widget billing cluster storage queue router mailer".split())
    secret = {
        "hex token": lambda: f"token = \"{some('0123456789abcdef', 40)}\" for the deploy",
        "environment": lambda: f"run with GITHUB_TOKEN={some(ALNUM, 36)} set",
        "json": lambda: '{"user": "bo", "client_secret": "' + some(ALNUM + "-_", 32) + '"}',
        "bearer": lambda: f"curl -H 'Authorization: Bearer {some(ALNUM, 44)}' now",
        "url": lambda: f"connect to postgres://svc:{some(ALNUM + '!$', 14)}@db.internal:5432/main please",
        "key id": lambda: f"aws_access_key_id = AKIA{some(string.ascii_uppercase + string.digits, 16)}",
        "password": lambda: f"password: {some(string.ascii_letters, 6)}{some('!@$%', 1)}{some(ALNUM, 7)}{some(string.digits, 2)}",
    }
    other = {
        "lock file": lambda: f"resolved registry integrity sha512-{b64(64)}",
        "image": lambda: f"<img src=\"data:image/png;base64,{b64(60)}\">",
        "path": lambda: f"see core/src/main/scala/org/{word()}/{word()}/{word().title()}Suite000{r.randint(1, 9)} for more",
        "commit": lambda: f"fixed in commit {some('0123456789abcdef', 40)} last week",
        "digest": lambda: f"pulled image@sha256:{some('0123456789abcdef', 64)}",
        "uuid": lambda: "request uuid " + "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        "slug": lambda: f"at /{word()}/{word()}-{word()}-{r.randint(10, 99)}/{word()}-{word()} today",
        "placeholder": lambda: "password = \"your_password_here_123\"",
    }
    return {k: [f() for _ in range(40)] for k, f in secret.items()}, {k: [f() for _ in range(40)] for k, f in other.items()}


@pytest.fixture(scope="module")
def shares(spark, docs):
    secret, other = kinds()
    rows = [(k, t) for texts in (secret, other) for k, ts in texts.items() for t in ts]
    found = secrets.scan(spark.createDataFrame(rows, "kind string, text string"), secrets.train(docs))
    hit: dict[str, list] = {}
    for r in found.select("kind", "_secrets", "_candidates").collect():
        hit.setdefault(r.kind, []).append(len(r._secrets) > 0)
    return {k: sum(v) / len(v) for k, v in hit.items()}, set(secret), set(other)


def test_secrets_are_found(shares):
    found, secret, _ = shares
    assert min(found[k] for k in secret) >= 0.9, {k: found[k] for k in secret}


def test_look_alikes_are_left(shares):
    found, _, other = shares
    assert max(found[k] for k in other) <= 0.1, {k: found[k] for k in other}


def test_passwords_of_urls(spark, docs):
    texts = ["postgres://admin:S3cr3tPassw0rd@host/db", "http://host:8080/a@b", "ftp://u:short@h", "x://a:b12345678901234@h y"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(secrets.candidates(secrets.F.col("text")).alias("c")).collect()
    assert [[c.value for c in r.c] for r in got] == [["S3cr3tPassw0rd"], [], [], ["b12345678901234"]]
    assert got[0].c[0].before.endswith("://admin:") and got[0].c[0].after.startswith("@host")
