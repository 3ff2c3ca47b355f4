from __future__ import annotations

import re
from collections import Counter
from math import floor, log

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from lattica.llm import sketches as S

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("n", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top):
    """Every document scored for every item."""
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * len(held)) // total
            s = sum(floor(1000 * log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_query_against_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(S.SQL).fetchall()
    assert rows(S.op12_sketch_search(spark, SF)) == sorted(want, key=str) and len(want) > 200


@pytest.mark.parametrize("top,partitions", [(1, 3), (3, 7), (50, 1)])
def test_edge_rows_against_brute_force(spark, top, partitions):
    """Nulls, empty texts, ties, repeated rows, one very long text, words beyond ASCII, many equal terms."""
    docs = [(1, "the cat sat"), (2, "The CAT sat"), (2, "The CAT sat"), (3, None), (4, ""), (None, "cat ÄÖ straße"), (5, "äö Straße 12 12 12"), (6, "dog " * 3000 + "cat"), (7, " ".join(f"w{i}" for i in range(30_000)) + " cat"), (8, ".,;"), (9, "x" * 100_000)]
    docs += [(100 + i, f"cat number {i} of many") for i in range(60)]
    items = [(1, "cat"), (2, "CAT dog w17"), (2, "straße"), (3, None), (4, "nowhere"), (5, "12 ÄÖ äö"), (6, ""), (7, "the of many number 7 cat sat")]
    table = spark.createDataFrame([(i, t, "x", None) for i, t in docs], DOCS).repartition(partitions)
    asked = spark.createDataFrame(items, ITEMS)
    index = S.build_index(table)
    want = brute(docs, items, top)
    assert rows(S.search(index, asked, top)) == want
    assert rows(S.search(index, asked, top, at_once=2)) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "cat")], ITEMS)
    out = S.search(S.build_index(docs), items)
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
    full = S.build_index(spark.createDataFrame([(1, "cat", "", "")], DOCS))
    assert S.search(full, items.limit(0)).count() == 0


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}".encode() for i in range(400)]
    docs = [Counter(rng.choice(vocabulary, rng.integers(1, 900)).tolist()) for _ in range(60)]
    docs.append(Counter({b"t1": 70_000, b"t2": 255, b"t3": 254}))
    items = {i: set(rng.choice(vocabulary, 20).tolist()) for i in range(15)}
    n = np.array([sum(d.values()) for d in docs], np.int64)
    asked = S.Questions(items, {t: int(rng.integers(0, 9000)) for t in vocabulary}, len(docs), int(n.sum()))
    sketches = [S.sketch(list(d), np.array(list(d.values()), np.uint32)) for d in docs]
    seen, loose = 0, []
    for some, bounds in asked.bounds(n, sketches):
        for row, doc in zip(bounds, some.tolist(), strict=True):
            for i in range(len(asked.items)):
                score = asked.score(docs[doc], int(asked.length(int(n[doc]))), i)
                assert row[i] + 1 >= score
                loose.append(row[i] / max(1, score))
                seen += 1
    assert seen == len(docs) * len(asked.items) and np.median(loose) < 1.2


def test_document_frequency(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(40)
    items = next(S._batches_of(spark.read.parquet(f"{SF}/benchmark.parquet"), 100, 1 << 20))
    df = S._document_frequency(S.build_index(docs), set().union(*items.values()))
    held = [set(words(r.text)) for r in docs.collect()]
    assert df == {t: n for t in set().union(*items.values()) if (n := sum(t.decode() in h for h in held))}
