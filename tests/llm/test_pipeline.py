from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

import corpus_pipeline as P
from lattica.llm.toxicity import Scorer, train
from tests.llm.test_decontaminate import contained
from tests.llm.test_line_dedup import brute as texts_left
from tests.llm.test_simhash import classes, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    import sentencepiece

    from lattica.llm.wordpieces import model_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    steps = [docs]
    for _, stage in P.STAGES:
        steps.append(stage(spark, steps[-1], SF).persist())
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert all(s.columns == docs.columns for s in steps[1:-1])

    scorer = Scorer(train(docs, labels))
    assert set(rows[1]) == {i for i, r in rows[0].items() if scorer.score([r.text])[0][0] < 0.3}
    assert all(rows[1][i] == rows[0][i] for i in rows[1])

    left = texts_left([(i, r.text) for i, r in rows[1].items()])
    assert {i: r.text for i, r in rows[2].items()} == left

    fps = {i: plain_fingerprint(r.text) for i, r in rows[2].items()}
    by, least = classes(fps.values()), defaultdict(lambda: 1 << 60)
    for i, f in fps.items():
        least[by[f]] = min(least[by[f]], i)
    assert set(rows[3]) == set(least.values())

    assert set(rows[4]) == {i for i, r in rows[3].items() if not any(contained(r.text, x.text) for x in items)}

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        ids = model.encode(rows[4][i].text, add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert len(rows[5]) < len(rows[0])


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 100
    assert [n for n, _ in P.STAGES] == [re.sub(r"\W", "_", n) for n, _ in P.STAGES]
