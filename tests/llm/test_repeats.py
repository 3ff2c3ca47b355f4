from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lattica.functions import storage
from lattica.llm import repeats as R

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("dk", T.StringType()), T.StructField("held", T.StringType())])


def brute(docs, length):
    """Counts every window of every text."""
    held = [(i, (t or "").encode()) for i, t in docs]
    counts = Counter(x[k : k + length] for _, x in held for k in range(len(x) - length + 1))
    out = []
    for i, x in held:
        gone = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - length + 1):
            if counts[x[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(x, gone[:-1], strict=True) if not g)
        out.append((i, len(x), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in R.op13_repeats(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(docs, 200) and sum(x[2] > 0 for x in got) > 5


@pytest.mark.parametrize("hot,block,many", [(1 << 20, 1 << 20, 1024), (300, 500, 2), (0, 1, 1024), (0, 1, 1)])
def test_edge_rows_against_brute_force(spark, monkeypatch, hot, block, many):
    """Nulls, empty texts, copies, periodic and long texts, passages in many contexts, bytes of several, zeros; hot keys and cold ones."""
    monkeypatch.setattr(R, "MANY", many)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, copy = prose(12), prose(30)
    docs = [(1, None), (2, ""), (None, prose(9)), (3, copy), (4, copy), (4, copy), (5, "ab" * 400), (6, "z" * 1000), (7, prose(500)), (8, "\0" * 90), (9, "short")]
    docs += [(10 + i, prose(r.randint(0, 5)) + passage + prose(r.randint(0, 5))) for i in range(25)]
    docs += [(50, copy[:70] + prose(3)), (51, passage[5:-3]), (52, prose(4) + copy[20:90] + passage), (53, "x" + "ab" * 30)]
    table = spark.createDataFrame([(i, t, "k", None, "h") for i, t in docs], SCHEMA).repartition(4)
    assert rows(R.without_repeats(table, 40, 16, hot, block)) == brute(docs, 40)


def test_only_the_table_of_the_result_is_left(spark):
    docs = spark.createDataFrame([(i, f"{'ab' * 40}{i % 3}", None, None, None) for i in range(9)], SCHEMA)
    before = set(storage.written())
    out = R.without_repeats(docs, length=12, anchor=4, hot_bytes=50, block=64)
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage.written() if p not in before] == ["repeats-left"]
    assert rows(out) == brute([(i, f"{'ab' * 40}{i % 3}") for i in range(9)], 12) and rows(out) == rows(out)


def test_hot_keys_are_cut_anew_and_not_into_windows(spark, monkeypatch):
    """Windows of a hot key were a row each; now each of its strings gives a few segments by longer anchors."""
    monkeypatch.setattr(R, "MANY", 1)
    r = random.Random(3)
    near = ["".join(r.choice("abcdefgh ") for _ in range(900)) for _ in range(2)]
    docs = [(i, t[:k] + "XYZ" + t[k + 3 :]) for i, (t, k) in enumerate((near[i % 2], r.randrange(890)) for i in range(60))]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)
    cut, whole = [], R._cut

    def counted(placed, length):
        out = whole(placed, length)
        cut.append(out.count())
        return out

    monkeypatch.setattr(R, "_cut", counted)
    assert rows(R.without_repeats(table, 200, 64, 0)) == brute(docs, 200)
    windows = sum(len(t) - 199 for _, t in docs)
    assert len(cut) > 2 and max(cut) < windows / 5


def test_empty_and_short_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.without_repeats(empty).count() == 0
    docs = [(1, "one"), (2, "one"), (3, None)]
    table = spark.createDataFrame([(i, t, "", "", "") for i, t in docs], SCHEMA)
    assert rows(R.without_repeats(table)) == brute(docs, 200)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 3)), min_size=1, max_size=6), st.integers(1, 12))
def test_intervals_against_counts(strings, length):
    held = [s for s, _ in strings]
    counts = Counter()
    for s, n in strings:
        for k in range(len(s) - length + 1):
            counts[s[k : k + length]] += n
    got = R.repeated_windows(held, [n for _, n in strings], length)
    assert [x.tolist() for x in got] == [[k for k in range(len(s) - length + 1) if counts[s[k : k + length]] > 1] for s in held]


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=120).map(lambda b: bytes(x % 4 for x in b)), st.integers(1, 20), st.data())
def test_common_prefixes_and_keys(text, length, data):
    anchor = data.draw(st.integers(1, length))
    held = np.frombuffer(text, np.uint8)
    symbols = np.append(held.astype(np.uint16) + 2, 0).astype(np.uint16)
    order = R.suffix_order(symbols, length)
    whole = symbols.tolist()
    cut = [whole[i : i + length] for i in order.tolist()]
    assert cut == sorted(whole[i : i + length] for i in range(len(whole)))
    assert R.prefix_edges(symbols, order, length).tolist() == [True] + [cut[i] != cut[i - 1] for i in range(1, len(cut))]
    keys = R.window_keys(held, length, anchor)
    hashes = {text[i : i + anchor]: h for i, h in enumerate(R.string_hashes(held, anchor).tolist())}
    assert keys.tolist() == [min(hashes[text[i + k : i + k + anchor]] for k in range(length - anchor + 1)) for i in range(max(0, len(text) - length + 1))]
    starts, sizes = R.segments(keys, 5)
    assert sum(sizes.tolist()) == len(keys) and all(len(set(keys[a : a + n].tolist())) == 1 and n <= 5 for a, n in zip(starts.tolist(), sizes.tolist(), strict=True))
