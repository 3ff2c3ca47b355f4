from __future__ import annotations

import random
import hashlib
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.secrets import ALPHABET, MarkovModel, redact_secrets, scan_secrets, secret_digest, train

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
H = "0123456789abcdef"


def brute(text):
    return sorted((m.start(), rank, m.end(), kind) for rank, (kind, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


HARD = [
    "", None, "secret:token = abcdefg", "secret=token=abcdef", 'API_KEY"  :  "zz..9-/', "Passwd= short", "ſecret=abcdefg", "toKen=abcdefg",
    f"\U0001f600 token={H * 2} x{H}{H}y {H}{H}", "AKIAAKIA" + "A1" * 9, "XAKIA12 AKIA" + "Z" * 16, H * 4000, "a1 " * 20000, "password:" * 3000 + "x",
    f"token={H}\n{H}{H}g{H}{H}", "tokentoken=abcdef", "api-key=abcdef apikey=abcdef api_key=a", " token =abcdefg",
]


def test_base_spans_against_brute_force(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("base", T.StringType()), T.StructField("found", T.StringType())])
    docs = spark.createDataFrame([(i, t, "b", None) for i, t in enumerate(HARD)] + [(None, "token=abcdef", "", "")], schema)
    for r in secret_digest(scan_secrets(docs)).collect():
        spans = brute(HARD[r.doc_id] if r.doc_id is not None else "token=abcdef")
        assert r.base_sha256 == digest(spans), r
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in spans) for k, _, _ in KINDS)
    assert secret_digest(scan_secrets(docs.limit(0), train(docs.limit(0)))).count() == 0


def test_documents_and_markov_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = "plain words and zQ8v1LmX0pR7sT2wK9bN3cJ6 between ordinary_identifier_names here"
    docs = docs.unionByName(spark.createDataFrame([(10**9, planted)], "doc_id long, text string"))
    model = train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    extra = 0
    for r in secret_digest(scan_secrets(docs, model)).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == digest(base)
        assert {f"{k}:{a}:{b}" for a, _, b, k in base} <= set(r.spans.split(","))
        extra += "markov" in r.spans
        if r.doc_id == 10**9:
            at = planted.index("zQ8")
            assert r.spans == f"markov:{at}:{at + 24}"
    assert extra <= 10
    hidden = redact_secrets(docs.where(F.col("doc_id") == 10**9), model).first().text
    assert hidden == "plain words and [markov] between ordinary_identifier_names here"


def test_threshold_sees_words_outside_the_sample(spark):
    """Most of the odd identifiers are outside the sample, and no more than the share that is allowed lies above the threshold."""
    from lattica.llm import secrets as M

    rng = random.Random(3)
    rows = [(i, f"password={''.join(rng.choices('abcdefghijklmnopqrstuvwxyz0123456789', k=20))} ordinary{chr(97 + i % 26)} identifier{chr(97 + i // 26 % 26)}") for i in range(2000)]
    rows += [(5000 + i, "".join(rng.choices("qxzjkvwy", k=24))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = M.train(docs, bound=100)
    words = M.labelled_tokens(docs, "text").where("secret = 0")
    above = words.where(model.score(words["value"]) > model.threshold).count()
    assert above <= M.MOST_FALSE * words.count()


def test_long_tokens_and_many_matches_with_a_model(spark):
    rng = random.Random(5)
    model = MarkovModel([rng.uniform(-1, 2) for _ in range((len(ALPHABET) + 1) ** 2)], 0.1)
    token = "".join(rng.choices(ALPHABET, k=1_000_000))
    lines = "\n".join(f"password = abc{i}defghi token: 0x{i:024x} own{i}Zq7Kx9Lm2Pw8 end" for i in range(10_000))
    docs = spark.createDataFrame([(1, f"own {token} end"), (2, lines)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_digest(scan_secrets(docs, model)).collect()}
    assert got[1].spans.endswith("markov:4:1000004")
    assert (got[2].n_assign, got[2].n_hex) == (20_000, 10_000) and got[2].spans.count("markov") > 1000


def test_scores_against_a_plain_model(spark):
    rng = random.Random(6)
    model = MarkovModel([rng.uniform(-1, 2) for _ in range((len(ALPHABET) + 1) ** 2)], 0.1)
    words = ["", "a", "ab", "é9é", *("".join(rng.choices(ALPHABET + "é ", k=rng.randrange(1, 40))) for _ in range(50))]
    at = lambda c: ALPHABET.find(c) if c in ALPHABET else len(ALPHABET)
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", model.score(F.col("w")).alias("x")).collect():
        own = [model.ratios[at(a) * (len(ALPHABET) + 1) + at(b)] for a, b in zip(r.w, r.w[1:])]
        assert r.x is None if not own else abs(r.x - sum(own) / len(own)) < 1e-9
