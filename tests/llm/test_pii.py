from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.pii import GENERATORS, Trees, find_personal, fit, personal_digest, redact_personal
from lattica.llm.spans import touched


def good_card(m):
    d = [int(c) for c in m[0] if c.isdigit()]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), good_card),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= sum(c.isdigit() for c in m[0]) <= 15),
]


def brute(text):
    return sorted((rank, m.start(), m.end(), kind) for rank, (kind, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for _, a, b, k in spans).encode()).hexdigest()


HARD = [
    "", None, "a@b.c_d@e.f x@y", "a@@b.c @x.y a@b..c a@b.c.", "q@r" + ".s" * 6000, "w." * 8000 + "@a.b", "m" * 20000 + " n@o.p",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3.0000000000000000000000000000000000000000000000009 9.9.9", "9" * 30000 + ".1.1.1 1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 41111111111111112222", "1 " * 9000, "4111  1111 4111111111111111-", "\U0001f600 4111 1111 1111 1111",
    "+1 (234) 555-0199 +12 +1-2 +1 2345678 +" + "1" * 16 + " +1(((((((2 ++1 23456789", "+1 234 567 8901 a@b.co +1 234",
    "12-34 5678 9012 3456 7", "0000000000000000", "x0@1.2.3.4 +1.2.3.4.5.6.7.8",
]


def test_base_spans_against_brute_force(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("base", T.StringType()), T.StructField("added", T.StringType())])
    docs = spark.createDataFrame([(i, t, "b", None) for i, t in enumerate(HARD)] + [(None, "a@b.c", "", "")], schema)
    for r in personal_digest(find_personal(docs)).collect():
        spans = brute(HARD[r.doc_id] if r.doc_id is not None else "a@b.c")
        assert r.spans == ",".join(f"{k}:{a}:{b}" for _, a, b, k in spans), HARD[r.doc_id or 0][:60]
        assert r.base_sha256 == digest(spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in spans) for k, _, _ in KINDS)
    assert personal_digest(find_personal(docs.limit(0), fit(docs.limit(0)))).count() == 0


def test_documents_and_added_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    planted = "the (974) 555-3436 of it and 123456 there"
    docs = docs.unionByName(spark.createDataFrame([(10**9, planted)], "doc_id long, text string"))
    trees = fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    extra = 0
    for r in personal_digest(find_personal(docs, trees)).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == digest(base)
        assert {f"{k}:{a}:{b}" for _, a, b, k in base} <= set(r.spans.split(",")) | {""} if base else True
        extra += len(r.spans.split(",")) - len(base) if r.spans else 0
        if r.doc_id == 10**9:
            assert r.spans == "phone:4:18"
    assert extra <= 20
    assert redact_personal(docs.where("doc_id = 1000000000"), trees).first().text == "the [phone] of it and 123456 there"


def test_thresholds_see_documents_outside_the_sample(spark):
    """International numbers that few sampled documents hold are calibrated on the others, and labelled as if 00 were a plus."""
    rows = [(i, f"call +1 234 555 {1000 + i} or {i}00 200 {3000 + i}") for i in range(400)]
    rows += [(1000 + i, f"ring 0044 20 7946 {1000 + i} today") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trees = fit(docs, bound=60)
    assert trees.thresholds[2] is not None
    got = {r.doc_id: r.spans for r in personal_digest(find_personal(docs, trees)).collect()}
    assert all(got[1000 + i] == "phone:5:22" for i in range(400))


def test_long_texts_with_many_matches(spark):
    """Time grows with the text: tens of thousands of spans and proposals in one text, with fitted trees."""
    text = "\n".join(f"user{i}@example{i % 97}.com, +1 555 {i:07d}, call 0{i % 9}12 345 6789" for i in range(20_000))
    always = Trees([1.0], [1.0], [0.0] * len(GENERATORS))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = personal_digest(find_personal(docs, always)).first()
    assert (r.n_email, r.n_phone) == (20_000, 20_000) and r.spans.count(",") > 59_000
    clean = redact_personal(docs).first().text
    assert clean.count("[email], [phone], call 0") == 20_000 and "@" not in clean


def test_touched_against_all_pairs(spark):
    rng = random.Random(3)
    kind = "array<struct<kind:string,start:int,end:int>>"
    rows = []
    for i in range(300):
        made = lambda n, kind: [(kind, s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(n))]
        rows.append((i, made(rng.randrange(9), "a"), made(rng.randrange(5), "b")))
    got = spark.createDataFrame(rows, f"id int, xs {kind}, ys {kind}").select("id", touched(F.col("xs"), F.col("ys")).alias("t")).collect()
    for r in got:
        _, xs, ys = rows[r.id]
        want = [((k, s, e), any(s < f and b < e for _, b, f in ys)) for k, s, e in xs]
        assert sorted((tuple(x.s), x.hit) for x in r.t) == sorted(want)
