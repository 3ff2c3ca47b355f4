from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from lattica.llm import toxicity as X


def by_enumeration(e, pairs):
    """Marginals of one short document by summing over all taggings."""
    total, toxic, joint = 0.0, np.zeros(len(e)), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=len(e)):
        p = np.exp(sum(e[i] for i, t in enumerate(tags) if t) + sum(pairs[a, b] for a, b in zip(tags, tags[1:])))
        total += p
        toxic += p * np.array(tags)
        for a, b in zip(tags, tags[1:]):
            joint[a, b] += p
    return toxic / total, joint / total


@pytest.mark.parametrize("sizes", [[1], [5], [1, 1, 7, 2], [3] * 60])
def test_marginals_against_enumeration(sizes):
    rng = np.random.default_rng(len(sizes))
    pairs = rng.normal(size=(2, 2))
    docs = [rng.normal(size=n) * 3 for n in sizes]
    starts = np.cumsum([0, *sizes[:-1]])
    got, joint = X.marginals(np.concatenate(docs), starts, pairs, joint=True)
    want = [by_enumeration(e, pairs) for e in docs]
    assert np.allclose(got, np.concatenate([w[0] for w in want]))
    assert np.allclose(joint, sum(w[1] for w in want))


def test_extreme_weights_stay_finite():
    got, _ = X.marginals(np.tile([1000.0, -1000.0, 0.0], 5000), np.array([0, 7]), np.array([[9.0, -9.0], [-9.0, 9.0]]))
    assert np.isfinite(got).all()


def test_held_out_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = {r.doc_id: r for r in X.op2_toxicity(spark, "/root/testdata/sf0.1").collect()}
    assert len(rows) == docs.count()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(rows[i].predicted, t) for i, t in toxic.items() if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    right = sum(p for p, t in held if t) / sum(t for _, t in held)
    wrong = sum(p for p, t in held if not t) / sum(1 for _, t in held if not t)
    assert right > 0.75 and wrong < 0.05
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {texts[i][int(s.split(":")[0]) : int(s.split(":")[1])].lower() for i, r in rows.items() for s in r.spans.split(",") if s}
    assert {"idiot", "scum", "moron"} <= found


def test_nulls_repeats_and_empty_tables(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("toxic", T.StringType())])
    docs = spark.createDataFrame([(1, None, "x", "t"), (None, "İ vile stuff", None, None), (2, "", "", ""), (2, "", "", ""), (3, "good words " * 30000 + "vile", "", "")], schema)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    untrained = X.train(docs, labels)
    assert sorted((r.doc_id or 0, r.score < 0.3) for r in X.score_documents(docs, untrained).collect()) == [(0, True), (1, True), (2, True), (2, True), (3, True)]
    made = X.ToxicField({"=vile": 20.0}, -8.0, ((0, 0), (0, 0)), (3.0, 0.0))
    got = {r.doc_id: r for r in X.score_documents(docs, made).collect()}
    assert got[None].spans == [(2, 6)] and got[None].score > 0.9 and got[3].score > 0.9 and got[1].score < 0.01
    kept = X.drop_toxic(docs, made)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2]
    assert X.score_documents(docs.limit(0), made).count() == 0 and X.train(docs.limit(0), labels.limit(0)).weights == {}
