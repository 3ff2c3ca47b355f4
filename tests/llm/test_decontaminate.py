from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import types as T

from lattica.llm import decontaminate as D


def test_search_against_all_scores():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 30)))) for i in range(400)]
    index = D.Index(items)
    for threshold in (0.2, 0.5, 0.8):
        for _ in range(60):
            words = [w for _, text in rng.choices(items, k=rng.randrange(1, 5)) for w in text.split()[: rng.randrange(1, 20)]]
            terms = sorted(set(index.terms(words).tolist()) - {len(index.codes)})
            scores = {}
            for t in terms:
                for s, x in zip(index.segments[t], index.weights[t], strict=True):
                    scores[s] = scores.get(s, 0) + x
            want = {s: round(x, 9) for s, x in scores.items() if x >= threshold - 1e-9}
            assert {s: round(x, 9) for s, x in index.search(terms, threshold)} == want


def contained(text, item):
    a, b = D.words_of(text.lower()), D.words_of(item.lower())
    return f" {' '.join(b)} " in f" {' '.join(a)} "


def test_documents_against_containment(spark):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts, wanted = docs.collect(), items.collect()
    want = {(d.doc_id, i.item_id) for d in texts for i in wanted if contained(d.text, i.text)}
    rows = D.find_leaks(docs, items, at_once=15).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert want and want == got and len(rows) == len(got)
    kept = D.drop_leaks(docs, items, at_once=15)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in texts} - {d for d, _ in want} and kept.columns == docs.columns


def test_partial_and_moved_passages():
    item = "what is the tallest peak of the northern range that climbers reach in winter answer mount erebor by far"
    long = " ".join(f"long{i}" for i in range(300))
    index = D.Index([(1, item), (2, long), (3, "yes no"), (4, "?!"), (5, "hello"), (6, "Hello!")])
    assert [x[0] for x in index.leaks("well, HELLO there")] == [5, 6] and index.leaks("hellos") == []
    pad = lambda n: " ".join(f"pad{i % 97}" for i in range(n))
    for before in (0, 1, 47, 48, 95, 1000):
        assert [x[0] for x in index.leaks(f"{pad(before)} {item} {pad(60)}")] == [1]
        assert [x[0] for x in index.leaks(f"{pad(before)} {long} {pad(60)}")] == [2]
    assert index.leaks(item.rsplit("answer", 1)[0]) == []  # the answer is missing
    assert index.leaks(item.split("climbers")[1]) == []  # the question is missing
    assert index.leaks("") == [] and index.leaks(pad(5000)) == []


def test_nulls_repeats_and_empty_tables(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("score", T.StringType())])
    leak = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, leak, "a", None), (None, leak, "b", ""), (2, None, None, None), (3, "", "", ""), (1, leak, "a", None)], schema)
    items = spark.createDataFrame([(7, leak), (7, leak), (8, None), (None, leak), (9, "")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in D.find_leaks(docs, items).collect())
    assert got == [(0, 7), (1, 7), (1, 7)]
    assert sorted(r.doc_id for r in D.drop_leaks(docs, items).collect()) == [2, 3]
    assert D.find_leaks(docs.limit(0), items).count() == 0 and D.find_leaks(docs, items.limit(0)).count() == 0 and D.drop_leaks(docs, items.limit(0)).count() == 5


def exhaustive(index, text):
    """Items whose question and answer trigrams occur around any passage: no terms, no scores, every item against every passage."""
    words, found = D.words_of(text.lower()), set()
    for start in range(0, max(1, len(words) - D.PASSAGE + D.STRIDE), D.STRIDE):
        for item, size, question, answer in index.parts:
            near = words[max(0, start - size) : start + D.PASSAGE + size]
            around = {tuple(near[k : k + n]) for n in {len(g) for g in question | answer} for k in range(len(near) - n + 1)}
            q = len(question & around) / len(question)
            a = len(answer & around) / len(answer) if answer else q
            if q >= D.LEAST_QUESTION and a >= D.LEAST_ANSWER:
                found.add(item)
    return found


def test_recall_against_every_item_and_passage():
    """Items copied with words changed and left out, in the words of common prose: at least 0.9 of those that verify.

    Items of fewer than five words are no such search: their words must be neighbours, as the index has pairs.
    """
    rng = random.Random(11)
    common = [f"c{i}" for i in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.7 else f"r{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((5, 6, 9, 20, 47, 49, 60, 120))))) for i in range(80)]
    index, total, hit = D.Index(items), 0, 0
    for _, text in items:
        own = text.split()
        for rate in (0.0, 0.02, 0.05, 0.1):
            changed = [w if rng.random() >= rate else word() for w in own]
            changed = [w for w in changed if rng.random() >= rate / 2] or own
            document = " ".join([word() for _ in range(rng.randrange(150))] + changed + [word() for _ in range(rng.randrange(150))])
            want, got = exhaustive(index, document), {x[0] for x in index.leaks(document)}
            assert got <= want
            total, hit = total + len(want), hit + len(got)
    print("recall", hit, "of", total)
    assert total > 100 and hit >= 0.9 * total


def test_short_items_by_containment():
    rng = random.Random(12)
    word = lambda: f"c{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(1 + i % 4))) for i in range(200)]
    index = D.Index(items)
    for _ in range(100):
        document = " ".join(word() for _ in range(rng.randrange(1, 90)))
        got = {x[0] for x in index.leaks(document)}
        assert {i for i, text in items if contained(document, text)} <= got


@pytest.mark.parametrize("at_once", [1, 2, 20_000])
def test_turns_do_not_change_the_result(spark, at_once):
    """One item with several texts is one item in any number of indexes."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(n)) for n in (5, 6, 7, 12, 40, 90)]
    items = spark.createDataFrame([(7, x) for x in texts[:5]] + [(8, texts[5]), (8, None), (9, "alone")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before it " + " and then ".join(texts) + " after"), (2, texts[1]), (3, texts[2] + " " + texts[5]), (4, None), (5, "alone at last"), (6, "nothing of these")], "doc_id long, text string")
    got = sorted(tuple(r)[:2] for r in D.find_leaks(docs, items, at_once).collect())
    assert got == [(1, 7), (1, 8), (2, 7), (3, 7), (3, 8), (5, 9)]


def test_long_items_take_linear_time():
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 50_000)}" for _ in range(60_000)]
    index, began = D.Index([(1, " ".join(words))]), time.process_time()
    found = index.leaks("x y z " + " ".join(words) + " x y z")
    assert [f[0] for f in found] == [1] and found[0][2] == found[0][3] == 1.0 and time.process_time() - began < 20
