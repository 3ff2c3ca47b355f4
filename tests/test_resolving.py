from __future__ import annotations

import datetime
import random
import re
from collections import Counter, defaultdict
from math import log

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.functions.storage import materialize
from lattica.operators import budget as B
from lattica.operators import conditions as K
from lattica.operators import fixpoint as X
from lattica.operators import postings as P
from lattica.operators import subjects as S
from lattica.operators import walks as W
from lattica.plans import resolving


def resolved(seeds, calls, rounds):
    """The revising fixpoint in plain Python: seeds {name: (place, label, kind)}, calls [(name, callee, {place: own})]."""
    known, refused, heard = {n: (*v, "", "") for n, v in seeds.items()}, {}, set()
    for _ in range(rounds):
        said = defaultdict(list)
        for name, callee, own in calls:
            if name not in seeds and callee in known:
                place, label, kind = known[callee][:3]
                if own.get(place) is not None:
                    said[name].append((own[place], own.get(label), kind, callee))
        heard, before = set(said), (dict(known), dict(refused))
        for name, items in said.items():
            places = sorted({i[0] for i in items})
            if len(places) > 1:
                refused[name] = ",".join(map(str, places))
                known.pop(name, None)
                continue
            labels, kinds = {i[1] for i in items}, {i[2] for i in items}
            kind = kinds.pop() if len(kinds) == 1 else "unknown"
            told = ",".join(["kind"] * (kind == "unknown") + ["label"] * (len(labels) > 1))
            known[name] = (places[0], labels.pop() if len(labels) == 1 else None, kind, ",".join(sorted({i[3] for i in items})), told)
            refused.pop(name, None)
        if before == (known, refused):
            break
    out = {(n, *v, str(v[0]), "seed" if n in seeds else "derived" if n in heard else "unsupported") for n, v in known.items()}
    return out | {(n, None, None, None, None, None, places, "refused") for n, places in refused.items()}


def derived(spark, seeds, calls, rounds):
    given = spark.createDataFrame([(n, *v) for n, v in seeds.items()], "name string, place int, label int, kind string")
    passes = spark.createDataFrame(calls, "name string, callee string, own map<int,int>")
    return {tuple(r) for r in X.derive_revising(given, passes, rounds).collect()}


SEEDS = {"spawn": (1, 0, "task"), "pthread": (2, None, "thread")}


def test_a_late_contradiction_takes_an_early_answer_back(spark):
    """w forwards to a primitive at once, and three rounds later its other arm is seen: refused, and what rested on it is left alone."""
    calls = [
        ("w", "spawn", {1: 0}), ("a", "pthread", {2: 1}), ("b", "a", {1: 3}), ("w", "b", {3: 5}), ("over", "w", {0: 2}),
        ("kinds", "spawn", {1: 0, 0: 1}), ("kinds", "pthread", {2: 0}), ("above", "kinds", {0: 4}), ("off", "spawn", {9: 0}), ("spawn", "pthread", {2: 0}),
    ]
    got = derived(spark, SEEDS, calls, 8)
    assert got == resolved(SEEDS, calls, 8)
    states = {r[0]: r[7] for r in got}
    assert states == {"spawn": "seed", "pthread": "seed", "w": "refused", "a": "derived", "b": "derived", "over": "unsupported", "kinds": "derived", "above": "derived"}
    by = {r[0]: r for r in got}
    assert by["w"][6] == "0,5" and by["kinds"][3:6] == ("unknown", "pthread,spawn", "kind,label") and by["above"][3] == "unknown"


def test_answers_that_never_settle_end(spark):
    """Two names whose second arms rest on each other are known and refused in turn."""
    calls = [("a", "spawn", {1: 0}), ("b", "spawn", {1: 0}), ("a", "b", {0: 1}), ("b", "a", {0: 1})]
    for rounds in (1, 2, 3, 8):
        assert derived(spark, SEEDS, calls, rounds) == resolved(SEEDS, calls, rounds)
    assert {r[7] for r in derived(spark, SEEDS, calls, None)} <= {"seed", "derived", "refused"}


def test_random_calls_and_nulls(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(30)]
    calls = [(rng.choice(names), rng.choice(names + ["spawn", "pthread"]), {p: rng.randint(0, 1) for p in rng.sample(range(3), 2)}) for _ in range(60)]
    assert derived(spark, SEEDS, calls + [(None, "spawn", {1: 0}), ("x", None, {1: 0})], 8) == resolved(SEEDS, calls, 8)
    assert derived(spark, SEEDS, [], 8) == resolved(SEEDS, [], 8)
    deep = [("w0", "spawn", {1: 0})] + [(f"w{i + 1}", f"w{i}", {0: 0}) for i in range(11)]
    assert derived(spark, SEEDS, deep, None) == resolved(SEEDS, deep, 99)


def expression(rng, depth):
    """A condition's text and its value (True, False, None)."""
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([("defined(A)", True), ("defined B", False), ("X >= 2", None), ("defined ( C )", True), ("F(A, 1)", None), ("X", None)])
    kind = rng.choice("!&|&|(")
    if kind == "!":
        text, value = expression(rng, depth - 1)
        return (f"!({text})", None if value is None else not value)
    if kind == "(":
        text, value = expression(rng, depth - 1)
        return f"( {text} )", value
    parts = [expression(rng, depth - 1) for _ in range(rng.randint(2, 3))]
    decisive = kind == "|"
    values = [v for _, v in parts]
    value = decisive if decisive in values else None if None in values else not decisive
    return (" || " if decisive else "&&").join(f"({t})" for t, _ in parts), value


def test_conditions_against_their_trees(spark):
    rng = random.Random(7)
    texts = [expression(rng, 5) for _ in range(400)]
    # precedence, all nine pairs of both operators, and what cannot be read
    texts += [("defined(A) || defined(B) && X", True), ("defined(B) && X || defined(B)", False), ("!defined(A) || X", None), ("!!defined(A)", True), ("! defined B", True)]
    own = {"defined(A)": True, "defined(B)": False, "X": None}
    for a, x in own.items():
        for b, y in own.items():
            texts.append((f"{a} && {b}", False if False in (x, y) else None if None in (x, y) else True))
            texts.append((f"{a}||{b}", True if True in (x, y) else None if None in (x, y) else False))
    texts += [(t, None) for t in (None, "", "   ", "(", ")", "(defined(A)", "defined(A))", ")(", "()", "defined(A) defined(A)", "defined(A) == 1", "defined(A) &&", "&& defined(A)", "A != 1", "defined(A) | defined(C)", "defined()")]
    texts += [("defined(A) ||", True), ("defined(B) && ()", False), ("(" * 60 + "defined(A)" + ")" * 60, True)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", K.verdict(K.truth(F.col("t"), F.array(F.lit("A"), F.lit("C")))).alias("v")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(texts)] == texts


def test_chains_of_guards(spark):
    rows = [(1, 2, False), (1, 2, False), (2, 2, False), (2, 1, False), (3, 1, False), (3, 0, False), (4, 0, True), (5, 2, True)]
    df = spark.createDataFrame(rows, "g int, v int, n boolean")
    got = {r.g: r.x for r in df.groupBy("g").agg(K.chain_verdict(F.col("v"), F.col("n")).alias("x")).collect()}
    assert got == {1: "live", 2: "undecided", 3: "dead", 4: "live", 5: "dead"}


def test_subjects(spark):
    rows = [("f", "function", 5, False, "late"), ("f", "function", 3, True, ""), ("f", "variable", 9, True, "v"), ("f", "macro", 1, True, None), ("m", "macro", 7, None, ""), ("e", "enumeration", 1, True, ""), ("e", "typedef", 1, True, ""), ("both", "lock", 4, True, "x"), ("both", "enumeration", 4, True, ""), (None, "function", 1, True, ""), ("k", None, 1, True, "")]
    named = spark.createDataFrame(rows, "name string, kind string, rowid long, is_def boolean, brief string")
    asked = spark.createDataFrame([(n,) for n in ("f", "f", "m", "e", "both", "nowhere", "k", None, "")], "name string")
    got = {tuple(r) for r in S.resolve(asked, named).collect()}
    assert got == {
        ("f", "function", "macro,variable", 2, 3, "late", None), ("m", "macro", "", 1, 7, None, None), ("e", None, None, None, None, None, "undescribed: enumeration,typedef"),
        ("both", "lock", "", 1, 4, "x", None), ("nowhere", None, None, None, None, None, "absent"), ("k", None, None, None, None, None, "absent"), ("", None, None, None, None, None, "absent"),
    }
    assert S.resolve(asked.limit(0), named).count() == 0 and S.resolve(asked, named.limit(0)).where("miss = 'absent'").count() == 7


def test_walks_against_plain_search(spark):
    rng = random.Random(4)
    hops = {(rng.randint(0, 24), rng.randint(0, 24), c, f"k{rng.randint(0, 2)}" if c == "key" else None) for c in ("call", "key") for _ in range(60)}
    hops = [(a, b, c, k, "exact" if c == "call" else None, "declared" if c == "key" else None, c == "key" and (a + b) % 3 == 0) for a, b, c, k in sorted(hops, key=str) if a != b]
    termini, seeds = {3, 14}, [0, 1, 3]
    near = defaultdict(list)
    for h in sorted(hops, key=lambda h: (str(h[1]), h[2], h[3] or "")):
        near[h[0]].append(h)
    want = set()
    for seed in seeds:
        expanded, frontier = {seed}, {seed} - termini
        for depth in range(1, 5):
            cap, nexts = max(4 >> (depth - 1), 1), set()
            for a in frontier:
                for h in near[a][:cap]:
                    stop = "terminus" if h[1] in termini else "seen" if h[1] in expanded else "boundary" if h[6] else None
                    want.add((seed, depth, *h, max(len(near[a]) - cap, 0), stop))
                    nexts |= {h[1]} if stop is None else set()
            expanded |= nexts
            frontier = nexts
    schema = "src long, dst long, class string, key_name string, certainty string, strength string, crosses boolean"
    table = spark.createDataFrame(hops, schema).withColumn("name", F.col("dst").cast("string"))
    nodes = lambda xs: spark.createDataFrame([(x,) for x in xs], "node long")
    got = [tuple(r) for r in W.walk(nodes([*seeds, None]), table, nodes([*termini, None]), ["name", "class", "key_name"], 4, 4).collect()]
    assert set(got) == want and len(got) == len(want) and {w[10] for w in want} == {None, "seen", "boundary", "terminus"}
    assert W.walk(nodes([]), table, nodes([]), ["name"], 3, 2).count() == 0


DOCS = [(1, "The quick brown fox. The dog"), (2, "brown quick fox the fox"), (3, None), (4, ""), (5, "a a a a rose"), (6, "quick brown"), (None, "quick fox"), (7, "é quick_brown 42 FOX")]
ASKED = {1: "quick fox", 2: '"quick brown"', 3: 'brown "quick', 4: "rose nowhere", 5: "nowhere", 6: "", 7: '"a a" rose', 8: '"fox the" dog', 9: "THE the", 10: '""', 11: "quick_brown"}


def plain_search(docs, asked):
    words = lambda t: re.findall("[a-z0-9_]+", (t or "").lower())
    held = {i: words(t) for i, t in docs if i is not None}
    total = len(docs)
    mean = sum(len(words(t)) for _, t in docs) / total
    out = set()
    for q, text in asked.items():
        units = P.parsed(text)

        def hits(units):
            tf = {i: [sum(tuple(w[k : k + len(u)]) == u for k in range(len(w))) for u in units] for i, w in held.items()}
            df = [sum(x[j] > 0 for x in tf.values()) for j in range(len(units))]
            idf = [log(1 + (total - n + 0.5) / (n + 0.5)) for n in df]
            return {i: (sum(n > 0 for n in x), round(sum(w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(held[i]) / mean)) for w, n in zip(idf, x, strict=True)), 6)) for i, x in tf.items() if any(x)}

        found, widened = {i: v for i, v in hits(units).items() if v[0] == len(units)}, False
        loose = list(dict.fromkeys((w,) for u in units for w in u))
        if not found and len(loose) > 1:
            found, widened = hits(loose), True
        for r, (i, (n, s)) in enumerate(sorted(found.items(), key=lambda x: (-x[1][1], x[0])), 1):
            out.add((q, i, r, s, n, widened))
    return out


def test_index_against_plain_search_and_its_plan(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    index = P.build_postings(docs, "id", "text", buckets=16)
    found = P.search_index(index, spark, ASKED)
    want = plain_search(DOCS, ASKED)
    assert {tuple(r) for r in found.collect()} == want and {w[5] for w in want} == {True, False}
    assert {tuple(r) for r in P.search_index(index, spark, ASKED, top=1).collect()} == {w for w in want if w[2] == 1}
    plan = index.read(spark, ["fox", "dog"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket.* IN ", plan) and re.search(r"PushedFilters: \[In\(term, \[(fox,dog|dog,fox)\]\)\]", plan)
    held = Counter((r.term, r.doc) for r in index.read(spark, ["a", "fox"]).collect())
    assert held == {("a", 5): 4, ("fox", 1): 1, ("fox", 2): 2, ("fox", 7): 1}


def test_index_reads_each_text_once_and_files_terms_of_blocks(spark, monkeypatch):
    """A text was cut for the statistics, for a sample of the order and for the files, and each place of a word was a row."""
    monkeypatch.setattr(P, "BLOCK_CHARS", 40)
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    docs = [(i, f"the {'the ' * (i % 4)}w{i}") for i in range(50)] + [(None, "the")]
    table = spark.createDataFrame(docs, "id long, text string").coalesce(1).select("id", F.udf(counted)("text").alias("text"))
    index = P.build_postings(table, "id", "text", buckets=4)
    assert seen.value == len(docs) and (index.documents, index.mean_length) == (51, sum(len(t.split()) for _, t in docs) / 51)
    held = {(r.doc, r.n): list(r.at) for r in index.entries(spark, ["the"]).collect()}
    assert held == {(i, i % 4 + 2): list(range(i % 4 + 1)) for i in range(50)}
    assert spark.read.parquet(index.path).where("term = 'the'").count() < 50
    found = P.search_index(index, spark, {1: '"the the the"', 2: "w7"}).collect()
    assert {(r["query"], r.doc) for r in found} == {(1, i) for i in range(50) if i % 4 > 1} | {(2, 7)}


def test_index_of_nothing_and_batches(spark):
    none = P.build_postings(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert P.search_index(none, spark, {1: "a b", 2: ""}).count() == 0
    assert P.search_index(none, spark, {}).columns == ["query", "doc", "rank", "score", "n_hit", "widened"]
    with pytest.raises(ValueError):
        P.search_index(none, spark, dict.fromkeys(range(2000), "a"))


def test_budget_drops_rings_then_halves(spark):
    import json

    schema = "k int, nodes array<struct<name:string,depth:int>>, hops array<struct<from:string,to:string>>, xs array<string>, ys array<long>"
    nodes = [("a", 1), ("b", 1), ("c", 2), ("d", 3), ("é", 3)]
    hops = [("a", "c"), ("c", "d"), ("c", "é"), ("a", "b")]
    rows = [(1, nodes, hops, ["x"] * 3, [1]), (2, nodes, hops, ["x" * 20] * 9, [1] * 9), (3, None, None, None, None), (4, [("a", 1)], [], ["w" * 900], [7, 8])]
    df = spark.createDataFrame(rows, schema)

    def plain(row, budget):
        k, n, h, xs, ys = (x if x is not None else [] for x in row)
        rings = halvings = 0
        size = lambda: len(json.dumps({"k": k, "nodes": [{"name": a, "depth": d} for a, d in n], "hops": [{"from": a, "to": b} for a, b in h], "xs": xs, "ys": ys}, separators=(",", ":"), ensure_ascii=False).encode())
        for _ in range(64):
            if size() <= budget:
                break
            deep = max((d for _, d in n), default=0)
            if deep > 1:
                n = [x for x in n if x[1] < deep]
                names = {a for a, _ in n}
                h, rings = [x for x in h if x[0] in names and x[1] in names], rings + 1
            elif max(len(xs), len(ys)) > 1:
                xs, ys = (xs[: len(xs) // 2], ys) if len(xs) >= len(ys) else (xs, ys[: len(ys) // 2])
                halvings += 1
        return k, len(n), len(h), len(xs), len(ys), rings, halvings, size()

    for budget in (10_000, 330, 250, 150, 10):
        got = {(r.k, len(r.nodes), len(r.hops), len(r.xs), len(r.ys), r.rings, r.halvings, r.n_bytes) for r in B.shrink(df, "k", ["xs", "ys"], budget).collect()}
        assert got == {plain(r, budget) for r in rows}


def test_budget_steps_pass_over_each_array_once(spark):
    """Long chains, names at two depths, and hops to no node: a row of 700 nodes and 700 hops took minutes when each hop made the names anew."""
    import time

    nodes = [(f"n{i}", 1 + i % 3) for i in range(700)] + [("n0", 3), ("n2", 1)]
    hops = [(f"n{i}", f"n{(i * 7 + 1) % 700}") for i in range(700)] + [("n0", "gone"), ("n0", "n2")]
    schema = "k int, nodes array<struct<name:string,depth:int>>, hops array<struct<from:string,to:string>>, xs array<string>"
    df = spark.createDataFrame([(k, nodes, hops, ["x"] * 9) for k in range(4)], schema)
    began = time.monotonic()
    got = {(r.k, r.rings, len(r.nodes), tuple(map(tuple, r.hops)), r.halvings, r.left_out) for r in B.shrink(df, "k", ["xs"], 100).collect()}
    assert time.monotonic() - began < 30
    first = {n for n, d in nodes if d == 1}
    kept = tuple((a, b) for a, b in hops if a in first and b in first)
    size = sum(d == 1 for _, d in nodes)
    assert ("n0", "n2") in kept and got == {(k, 2, size, kept, 3, len(nodes) - size + len(hops) - len(kept) + 8) for k in range(4)}


def test_a_condition_is_read_once_however_many_rows_it_guards(spark, monkeypatch, tmp_path):
    from lattica.plans.catalogue import QUERIES

    line = spark.range(20_000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.lit(9.0).alias("l_quantity"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    own, log = K.truth, f"{tmp_path}/read"

    @F.udf("int")
    def noted(condition):
        with open(log, "a") as f:
            f.write("x")
        return 0

    monkeypatch.setattr(K, "truth", lambda text, defined: noted(text) + own(text, defined))
    assert QUERIES["conditions_evaluated"](spark, str(tmp_path)).count() == 8
    assert {r.verdict for r in QUERIES["guard_verdicts"](spark, str(tmp_path)).collect()} == {"live", "dead", "undecided"}
    read = (tmp_path / "read").read_text()
    assert 16 <= len(read) <= 32


def test_first_hops_of_hubs_and_that_hops_are_made_once(spark):
    """Hops were made twice, once for their places and once for their numbers; a hub's hops are dealt to several tasks."""
    rng = random.Random(7)
    hops = sorted({(rng.choice((1, 1, 1, 2, 3, 4)), rng.randint(0, 400), rng.randint(0, 2)) for _ in range(900)})
    near = defaultdict(list)
    for h in sorted(hops, key=lambda h: (-h[1], h[2])):
        near[h[0]].append(h)
    want = {(*h, i, len(near[h[0]])) for h in hops if (i := near[h[0]].index(h) + 1) <= 8}
    table = spark.createDataFrame(hops, "src long, dst long, k int").withColumn("back", -F.col("dst"))
    hubs = lambda xs: spark.createDataFrame([(x,) for x in xs], "src long")
    for given in (None, hubs([]), hubs([1, 1, 3, 99])):
        near = W.first_neighbours(table, ["back", "k"], 8, given)
        got = [tuple(r) for r in near.select("src", "dst", "k", "place", "n").collect()]
        assert set(got) == want and len(got) == len(want)
    plan = W.first_neighbours(table, ["back", "k"], 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and len(re.findall(r"Exchange hashpartitioning", plan)) == 1


@pytest.mark.parametrize("most", [20_000, 15])
def test_two_classes_of_odd_lines_as_their_sql(spark, tmp_path, monkeypatch, most):
    """Lines without a part, a supplier or a date, and parts that are not listed; with and without hubs."""
    monkeypatch.setattr(resolving, "HUB_LINES", most, raising=False)
    rng, day = random.Random(11), datetime.datetime(1995, 1, 3)
    parts = [(i, f"name {rng.randint(0, 9)}", f"Brand#{i % 3}", rng.choice(("SMALL TIN", "LARGE TIN")), 40 if i % 6 == 0 else rng.choice((3, 40, 42, 47))) for i in range(60)]
    often = [7, 11, 18, *range(60), None, 900]
    lines = [
        (o, rng.choice(often), rng.choice((*range(12), 12, None)), n, float(rng.randint(1, 50)), rng.choice(("A", "N", "R", "R", None)), rng.choice("OF"), rng.choice((None, *[day + datetime.timedelta(days=31 * m) for m in range(9)])))
        for o in range(150) for n in range(1, 6)
    ]
    tables = {
        "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "supplier": ([(i, float(i % 3 - 1)) for i in range(12)], "s_suppkey long, s_acctbal double"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    }
    duck = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = Counter(tuple(r) for r in duck.execute(resolving.ORACLES["chain_two_classes"]).fetchall())
    got = Counter(tuple(r) for r in resolving.QUERIES["chain_two_classes"](spark, str(tmp_path)).collect())
    assert got == want and {r[10] for r in want} == {None, "terminus", "seen", "boundary"} and {r[4] for r in want} == {"call", "key"}


def test_tables_filed_by_a_column_are_read_in_part(spark):
    """Each depth of a walk read all first hops of all nodes."""
    rows = [(i, i % 8 + 1, None if i % 3 else f"k{i}") for i in range(64)]
    filed = materialize(spark.createDataFrame(rows, "src long, place int, key_name string"), "filed", by=("place",)).where("place <= 2")
    assert Counter((r.src, r.place, r.key_name) for r in filed.collect()) == Counter(r for r in rows if r[1] <= 2)
    assert re.search(r"PartitionFilters: \[[^\]]*place", filed._jdf.queryExecution().executedPlan().toString())


def walked_whole(seeds, near, ends):
    """(seed, depth, dst, level, stop) of whole walks in plain Python; ``near``: {src: [(dst, level)]}, levels from 4 on cross."""
    rows = set()
    for seed in set(seeds):
        walked, touched, front, depth = {seed: 0}, set(), {seed}, 0
        while front:
            depth += 1
            best = {}
            for a in front:
                for b, level in near[a]:
                    best[b] = min(level, best.get(b, 9))
            front = {b for b, level in best.items() if level < 4 and b not in ends and b not in walked}
            for b, level in best.items():
                if b in front:
                    rows.add((seed, depth, b, level, None))
                elif b not in touched and (b not in walked or b == seed):
                    rows.add((seed, depth, b, level, "terminus" if b in ends else "seen" if b == seed else "boundary"))
            touched |= set(best)
            walked |= dict.fromkeys(front, depth)
    return rows


@pytest.mark.parametrize("hubs", [False, True])
def test_whole_walks_against_plain_search(spark, monkeypatch, hubs):
    """All hops and depths, with seeds in several rows of bits, rounds merged, and keys that meet without being paired."""
    monkeypatch.setattr(W, "MERGE", 2)
    rng = random.Random(8)
    ends, far = {5, 17, 33}, range(100, 107)
    hops = {(rng.randint(0, 39), rng.randint(0, 39), rng.randint(0, 1)) for _ in range(50)} | {(a, a + 1, 0) for a in far} | {(7, 100, 1)}
    hops = [(a, b, x) for a, b, x in hops if a != b and a not in ends]
    keys = [(rng.randint(0, 39), rng.randint(0, 8), rng.randint(0, 1)) for _ in range(60)]
    into, out = sorted({k for k in keys[:30] if k[0] not in ends}), sorted(set(keys[30:]) | {k for k in keys[:10]})
    near = defaultdict(list)
    for a, b, x in hops:
        near[a].append((b, x))
    for a, g, h in into:
        near[a] += [(b, (2 + g % 2) + 2 * (h != other)) for b, other_g, other in out if other_g == g and b != a]
    seeds = [0, 1, 5, 7, *far, 33, *range(10, 33)]
    # seeds that reach nothing lie between those that do, so that these are in other rows of bits
    idle = range(200, 900)
    nodes = spark.createDataFrame([(x,) for x in [*seeds, *idle, None] if x not in ends], "node long")
    about = spark.createDataFrame([(x, x in ends) for x in [*range(40), *far, 107]], "dst long, ends boolean")
    made = spark.createDataFrame
    many = made([(7,), (0,), (999,)], "src long") if hubs else None
    many_out = made([(g,) for g in range(5)], "group long") if hubs else None
    walks = W.whole_walks(
        nodes, made([(a, b, x, b in ends) for a, b, x in hops], "src long, dst long, level int, ends boolean"), made(into, "src long, group long, side long"),
        made([(g, h, b, 2 + g % 2, b in ends) for b, g, h in out], "group long, side long, dst long, level int, ends boolean"), 2, about, many, many_out,
    )
    got = [tuple(r) for r in walks.collect()]
    want = walked_whole([x for x in seeds if x not in ends], near, ends)
    assert set(got) == want and len(got) == len(want) and {w[4] for w in want} == {None, "terminus", "seen", "boundary"} and max(w[1] for w in want) > 6


def test_two_classes_are_walked_whole(spark, tmp_path):
    """Hops beyond the eighth of a part, keys with over 64 pairs and depths beyond six were left out."""
    day = datetime.datetime(1995, 1, 3)
    called = [(0, i) for i in range(1, 13)] + [(12, 21)] + [(i, i + 1) for i in range(21, 28)] + [(28, 0)]
    lines = [(o, part, None, n, 20.0, "A", "F", None) for o, pair in enumerate(called) for n, part in enumerate(pair)]
    lines += [(100 + i, part, 1, 1, 20.0, flag, "F", day) for i, (part, flag) in enumerate([(p, "R") for p in (0, *range(31, 39))] + [(p, "N") for p in range(41, 50)])]
    tables = {
        "part": ([(i, f"p {i}", "Brand#1", "SMALL TIN", 40 if i == 0 else 3) for i in range(50)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "supplier": ([(1, 5.0)], "s_suppkey long, s_acctbal double"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    }
    duck = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = Counter(tuple(r) for r in resolving.QUERIES["chain_two_classes"](spark, str(tmp_path)).collect())
    assert got == Counter(tuple(r) for r in duck.execute(resolving.ORACLES["chain_two_classes"]).fetchall())
    want = {(i, 1, "call", None) for i in range(1, 13)} | {(i, i - 19, "call", None) for i in range(21, 29)} | {(i, 1, "key", None) for i in range(41, 50)} | {(0, 10, "call", "seen")}
    assert {(r[2], r[1], r[4], r[10]) for r in got} == want and {(r[8], r[9]) for r in got if r[2] == 0} == {(12, 9)}
