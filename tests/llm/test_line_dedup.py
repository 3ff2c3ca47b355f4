from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import types as T

from lattica.llm import line_dedup as L


def plain(record):
    """Tokens of a record as strings; nothing here comes from the operator."""
    return tuple("<*>" if re.search(r"\d", t) else t for t in record.rstrip(". \t\r").split())


def templates(text):
    """Of each line: templates of the whole as (kind, key, value), and of its sentences, all as strings."""
    out = []
    for line in text.split("\n"):
        parts = line.split(". ")
        tokens = tuple(t for p in parts for t in plain(p))
        n, own = len(tokens), []
        if n >= 3 and set(tokens) != {"<*>"}:
            own.append((("line", tokens), None))
            if n >= 6:
                thirds = [tokens[n * i // 3 : n * (i + 1) // 3] for i in range(3)]
                for i in range(3):
                    rest = tuple(t for j, x in enumerate(thirds) if j != i for t in x)
                    if set(rest) != {"<*>"}:
                        own.append((("varied", n, i, tuple(x for j, x in enumerate(thirds) if j != i)), thirds[i]))
        inner = [("sentence", p) if len(p) >= 6 and set(p) != {"<*>"} else None for p in map(plain, parts)] if len(parts) > 1 else []
        out.append((line, parts, own, inner))
    return out


def brute(rows):
    """Texts left, by comparing templates as strings, all in one place."""
    have, values, seen = defaultdict(set), defaultdict(set), {}
    for doc, text in rows:
        first = {}
        for _, _, own, inner in templates(text):
            for key, value in own:
                have[key].add(doc)
                first.setdefault(key, value)
            for key in inner:
                if key:
                    have[key].add(doc)
        for key, value in first.items():
            values[key].add(value)
    for key, docs in have.items():
        varied = key[0] == "varied"
        if len(docs) >= (3 if varied else 2) and (not varied or len(values[key]) > 1):
            seen[key] = min(docs)
    result = {}
    for doc, text in rows:
        again = lambda key: key in seen and seen[key] < doc  # noqa: B023, E731
        lines = []
        for line, parts, own, inner in templates(text):
            if any(again(key) for key, _ in own):
                continue
            gone = [key is not None and again(key) for key in inner]
            if any(gone):
                kept = [p for p, g in zip(parts, gone, strict=True) if not g]
                if not any(p.strip() for p in kept):
                    continue
                line = ". ".join(kept) + ("." if gone[-1] and not kept[-1].rstrip().endswith(".") else "")
            lines.append(line)
        result[doc] = "\n".join(lines)
    return result


PASSAGE = "First words of the shared passage go on. They carry on for a while and then end. Short. The third sentence of this passage is a rather long one"


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = {r.doc_id: r.text for r in L.drop_recurring_lines(docs).collect()}
    assert got == want
    assert sum(t != want[d] for d, t in rows) > 100


def test_passages_templates_and_short_lines(spark):
    unique = lambda i: " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(9))
    rows = [(i, f"{unique(i)} {PASSAGE}. {unique(i)[::-1]} end.\nShort.") for i in range(3)]
    rows += [(10 + i, f"User logged in from the host with name h{i} at time {i}:00 and then left the building again.\nown text {unique(i)}") for i in range(3)]
    rows += [(100 + i, f"All rights reserved.\n{unique(i)} {i}") for i in range(25)]
    rows += [(200 + i, "Login of user " + chr(97 + i) * 5 + " from the office refused") for i in range(3)]
    rows += [(230 + i, "user " + chr(97 + i) * 5 + " logged in from host a17 at noon") for i in range(3)]
    rows += [(300 + i, f"The. {unique(i)} {i} of its own\nOf.") for i in range(25)]
    rows += [(400 + i, "One pair of lines differs only here " + "xy"[i] + " and is in two") for i in range(2)]
    got = {r.doc_id: r.text for r in L.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(got[d] == texts[d] for d in (0, 10, 100, 200, 230, 400, 401))
    assert all(got[300 + i] == texts[300 + i] for i in range(25))
    for i in (1, 2):
        assert "third sentence" not in got[i] and "carry on" not in got[i] and unique(i)[::-1] in got[i] and unique(i) in got[i] and got[i].endswith("\nShort.")
        assert got[10 + i] == f"own text {unique(i)}"
        assert got[200 + i] == got[230 + i] == ""
    assert all(got[100 + i] == f"{unique(i)} {i}" for i in range(1, 25))
    assert got == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    names = ["doc_id", "text", "found", "template", "__id0", "__found0", "n_dropped"]
    schema = T.StructType([T.StructField(c, T.StringType() if c in ("text", "found") else T.LongType()) for c in names])
    rows = [(None, PASSAGE, "x", 1), (1, None, None, None), (2, PASSAGE, "", 2), (2, PASSAGE, "", 2), (3, PASSAGE, "z", 3), (4, "", "", 4), (5, ". . .\n\n " * 1000, "", 5), (6, "1 2 3\n4 5 6 7 8 9", "", 6), (7, "1 2 3\n4 5 6 7 8 9", "", 7)]
    docs = spark.createDataFrame([(*r, 0, 0, 9) for r in rows], schema)
    out = L.drop_recurring_lines(docs)
    assert out.columns == docs.columns
    want = [(0, PASSAGE), (1, None), (2, PASSAGE), (2, PASSAGE), (3, ""), (4, ""), *((r[0], r[1]) for r in rows[6:])]
    assert sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    counted = {r.doc_id: r.n_dropped for r in L.drop_recurring_lines(docs, counts=True).collect()}
    assert counted == {None: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    assert L.drop_recurring_lines(docs.limit(0)).count() == 0


def test_whole_lines_of_short_sentences(spark):
    own = lambda i: " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(9))
    rows = [(i, f"{own(i)} {i}\nAll of it. No more of it.\nYes. {own(i)} alone. All of it") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in L.drop_recurring_lines(docs, counts=True).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text == f"{own(i)} {i}\nYes. {own(i)} alone. All of it" and got[i].n_dropped == 1 for i in range(1, 25))


def test_common_templates_go_by_the_broadcast_join(spark, monkeypatch):
    monkeypatch.setattr(L, "COMMON_OF", 10)
    rows = [(i, f"This line is in every one of them.\nown {chr(97 + i % 26)}{chr(97 + i // 26)} words") for i in range(100)]
    got = {r.doc_id: r.text for r in L.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum("every one" in t for t in got.values()) == 1
