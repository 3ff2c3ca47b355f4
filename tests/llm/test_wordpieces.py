from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from lattica.llm.wordpieces import ChunkEncoder, decode_pieces, encode_pieces, model_path, piece_round_trip

TEXTS = ["", "a", " a", "a  b\n c ", "\n\nx\n y", "▁x ▁", "\t tab　ﬁ é é", "x" * 5000, "many " * 9000, "\x00 nul", "<s> </s> <0x0A>", "日本語 テキスト\r\n", "    four", "\n", " ", None, "a"]


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.mark.parametrize("limit", [4, 100_000])
def test_chunks_equal_the_library(model, limit):
    mine = ChunkEncoder(model_path(), limit)
    for text in TEXTS:
        assert np.frombuffer(mine.encode(text or ""), "<u4").tolist() == model.encode(text or "", add_bos=True, add_eos=True)


def test_documents_equal_the_library(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in piece_round_trip(docs).collect()}
    for r in docs.collect():
        ids = model.encode(r.text, add_bos=True, add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_nulls_repeats_and_empty_tables(spark, model):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])
    docs = spark.createDataFrame([(1, None, "x"), (None, "b", None), (2, "b c", "y"), (2, "b c", "y")], schema)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in piece_round_trip(docs).collect())
    assert got == [(0, 3), (1, 2), (2, 4), (2, 4)]
    assert piece_round_trip(docs.limit(0)).count() == 0
    back = {(r.doc_id, r.text) for r in decode_pieces(encode_pieces(docs)).collect()}
    assert back == {(1, ""), (None, "b"), (2, "b c")}
