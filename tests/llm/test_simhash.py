from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import types as T

from lattica.llm.simhash import drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, most=4):
    up = {f: f for f in fps}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", ["", " \n", "One", "a B c", "a b c d e f", "Ä É x\x85y z\x1cw q r s", "same same same same same same", "w " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("hot, block", [(64, 1024), (1, 3)])
def test_links_against_all_pairs(spark, hot, block):
    rng = random.Random(3)
    bases = [rng.getrandbits(64) for _ in range(30)]
    fps = {0, (1 << 64) - 1}
    for b in bases:
        for _ in range(6):
            x = b
            for _ in range(rng.randrange(0, 7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), hot_key=hot, block=block).collect()
    pairs = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in got}
    true = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    assert pairs <= true
    if hot == 64:
        assert pairs == true
    up = {f: f for f in fps}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert {f: find(f) for f in fps} == classes(fps)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    by = classes(fps.values())
    least = {}
    for d, f in fps.items():
        least[by[f]] = min(least.get(by[f], d), d)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == least[by[fps[r.doc_id]]]
    kept = drop_near_duplicates(docs)
    assert {r.doc_id for r in kept.collect()} == set(least.values()) and kept.columns == docs.columns


def test_nulls_repeats_and_empty_tables(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("root", T.StringType())])
    docs = spark.createDataFrame([(5, None, "x", None), (4, "", "x", "r"), (None, "alone", None, None), (2, "b c", "y", ""), (2, "b c", "y", ""), (9, "B  c", "z", "")], schema)
    got = sorted((r.doc_id or 0, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(0, None), (2, 2), (2, 2), (4, 4), (5, 4), (9, 2)]
    kept = drop_near_duplicates(docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4] and set(kept.columns) == set(docs.columns)
    assert near_duplicates(docs.limit(0)).count() == 0
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_drop_judges_repeated_ids_by_row(spark):
    """An id keeps the text for which it is the one of a component; two components of one id keep a text each."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    schema = "doc_id long, text string, fp string, root string, component_id string"
    rows = [(5, a), (3, b), (5, b), (7, c), (5, c), (5, c), (None, a), (None, "none of them has an id"), (9, None), (9, ""), (10, "")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], schema)
    got = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()), key=str)
    assert len(got) == 5 and {x for x in got if x[0] != 9} == {(5, a), (3, b), (5, c), (None, "none of them has an id")}
    assert drop_near_duplicates(docs).columns == docs.columns and drop_near_duplicates(docs.limit(0)).count() == 0
