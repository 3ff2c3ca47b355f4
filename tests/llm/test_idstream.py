from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lattica.llm.idstream import WordEncoder, pack, read_blocks, store_ids, tokenizer_path, unpack, with_checksums


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**16 + 3), st.integers(0, 2**32 - 1)), max_size=40))
def test_pack_round_trip(values):
    control, data = pack(np.array(values, np.uint32))
    assert unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    for limit in (3, 1000):
        mine = WordEncoder(tokenizer_path(), limit, limit)
        for text in ["", "  ", "It's  DON'T\n\tx", "é́ é ́x", "<|endoftext|> a<|endoftext|>b", "ΑΣ ΑΣ. İ", "".join(f"{chr(c)}a{chr(c)} {chr(c)}, x{chr(c)}###.!! " for c in range(0xC0, 0x100)), "a\xa0b\x1cc\x85d", "日本 語123", "w" * 3000, "x " * 4000, "Straße, ÀÉÞ!! don't. a.b c's' x<|endoftext|>. ÿ### Ǆ, µ. ªº× ÷÷ a``'' {x}~ it's, A'S"]:
            assert np.frombuffer(mine.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in with_checksums(store_ids(docs)).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids + [1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (start, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_nulls_repeats_and_empty_tables(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType())])
    docs = spark.createDataFrame([(3, None, "x"), (None, "b", None), (2, "b c", "y"), (2, "b c", "y")], schema)
    got = [(r.doc_id, r.start, r.n_tokens) for r in store_ids(docs).orderBy("start").collect()]
    assert got == [(None, 0, 2), (2, 2, 3), (2, 5, 3), (3, 8, 1)]
    assert store_ids(docs.limit(0)).count() == 0


def test_files_alone_give_the_ids_and_equal_ids_have_a_fixed_order(spark, tmp_path):
    rows = [(7, f"own text {chr(97 + i % 26) * (i + 1)}") for i in range(60)] + [(None, f"x{i} y") for i in range(20)]
    folder = f"file://{tmp_path}/ids"
    wrote = sorted((r.start, r.doc_id or 0, bytes(r.ids)) for r in store_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), folder=folder).collect())
    again = sorted((r.start, r.doc_id or 0, bytes(r.ids)) for r in read_blocks(spark, folder).collect())
    other = sorted((r.start, r.doc_id or 0, bytes(r.ids)) for r in store_ids(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect())
    assert wrote == again == other and len(wrote) == 80
