from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lattica.llm import alignment as A
from lattica.llm.wordpieces import model_path

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_a", T.StringType()), T.StructField("links", T.StringType())])
TEXTS = ["", None, "a", " a", "two  spaces\n\nand lines ", "the same", "the same", "ﬁne é é", "x" * 3000, "many words " * 4000, "<|endoftext|> <s> </s> <0x0A>", "▁x ▁", "日本語 テキスト\r\n", "\n", " ", "\x00 nul", "tail\t\t \n "]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.byte_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=model_path())


def brute(tokenizers, docs):
    """Through the libraries themselves, with sets of ends."""
    a, b = tokenizers
    alphabet = A.unicode_bytes()
    held = []
    for i, text in docs:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids
        y = b.encode(text or "")
        xs = [bytes(alphabet[c] for c in a.id_to_token(t)) for t in x]
        ys = [bytes([int(p[3:-1], 16)]) if b.is_byte(t) else p.replace("▁", " ").encode() for t in y for p in [b.id_to_piece(t)]]
        whole = b" " + (text or "").encode()
        if not text or b"".join(xs) != whole or b"".join(ys) != whole:
            held.append((i, None))
            continue
        ends = [dict(zip(np.cumsum([len(t) for t in s]).tolist(), range(len(s)), strict=True)) for s in (xs, ys)]
        common = sorted(ends[0].keys() & ends[1].keys())
        held.append((i, (x, y, [(ends[0][e], ends[1][e]) for e in common])))
    counts = Counter((x[p], y[q]) for _, h in held if h for x, y, links in [h] for p, q in links)
    most = defaultdict(int)
    for (_, t), n in counts.items():
        most[t] = max(most[t], n)
    out = []
    for i, h in held:
        if h is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, links = h
        groups, p0, q0 = [], 0, 0
        for p, q in links:
            groups.append(",".join(map(str, x[p0 : p + 1])) + "|" + ",".join(map(str, y[q0 : q + 1])))
            p0, q0 = p + 1, q + 1
        pairs = [(x[p], y[q]) for p, q in links]
        out.append((i, len(x), len(y), len(links), len(links), sum(counts[z] == most[z[1]] for z in pairs), sum(counts[z] for z in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_against_the_libraries(spark, tokenizers):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = rows(A.op11_alignment(spark, "/root/testdata/sf0.001"))
    assert got == brute(tokenizers, docs) and sum(r[3] > 0 for r in got) > 100


def test_edge_rows(spark, tokenizers):
    docs = list(enumerate(TEXTS)) + [(None, "no id"), (3, " a")]
    table = spark.createDataFrame([(i, t, "x", None) for i, t in docs], SCHEMA).repartition(3)
    assert rows(A.tokenizer_alignment(table)) == brute(tokenizers, docs)


def test_empty_table(spark):
    out = A.tokenizer_alignment(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[0] == "doc_id"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=60), st.integers(0, 2**31)), max_size=8), st.integers(1, 9))
def test_lockstep_of_lanes_equals_set_intersection(docs, lane):
    """Any two ways of cutting the same bytes, with lanes of any length."""
    a_ends, b_ends = [], []
    for sizes, seed in docs:
        ends = np.cumsum(sizes).astype(np.int64)
        rng = np.random.default_rng(seed)
        other = np.flatnonzero(rng.random(int(ends[-1]) if len(ends) else 0) < 0.4) + 1
        a_ends.append(ends)
        b_ends.append(np.union1d(other, ends[-1:]).astype(np.int64))
    a_at, b_at = np.cumsum([0, *map(len, a_ends)]), np.cumsum([0, *map(len, b_ends)])
    cut = [(d, *x) for d in range(len(docs)) for x in A.lanes(a_ends[d], b_ends[d], lane)]
    doc, i, j = np.array(cut, np.int64).reshape(-1, 3).T
    a_from, b_from = a_at[doc] + i, b_at[doc] + j
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    a_to, b_to = np.where(last, a_at[doc + 1], np.append(a_from[1:], 0)), np.where(last, b_at[doc + 1], np.append(b_from[1:], 0))
    none = [np.zeros(0, np.int64)]
    p, q = A.lockstep(np.concatenate(a_ends or none), np.concatenate(b_ends or none), a_from, a_to, b_from, b_to)
    want = [(a_at[d] + x, b_at[d] + y) for d in range(len(docs)) for _, x, y in zip(*np.intersect1d(a_ends[d], b_ends[d], return_indices=True), strict=True)]
    assert list(zip(p.tolist(), q.tolist(), strict=True)) == [(int(x), int(y)) for x, y in want]


def test_pairs_are_bounded_by_the_vocabularies(spark):
    pair = A._pair(A.byte_path(), model_path())
    possible = pair.possible_pairs()
    assert len(possible) < 1_000_000
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {(r.a_id, r.b_id) for r in A.pair_counts(A.linked(docs)).collect()}
    assert found <= possible


def test_places_of_the_general_form(spark):
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(TEXTS)], SCHEMA)
    pair = A._pair(A.byte_path(), model_path())
    ints = lambda x: np.frombuffer(bytes(x), "<u4")
    seen = 0
    for r in A.align_documents(docs).collect():
        a_ends, b_ends = np.cumsum(pair.a_sizes[ints(r.a_ids)]), np.cumsum(pair.b_sizes[ints(r.b_ids)])
        assert (r.n_a, r.n_b, r.n_groups) == (len(a_ends), len(b_ends), len(ints(r.a_ends)))
        assert a_ends[ints(r.a_ends)].tolist() == b_ends[ints(r.b_ends)].tolist() == np.intersect1d(a_ends, b_ends).tolist()
        seen += r.n_groups > 0
    assert seen > 8
