from __future__ import annotations

from collections import deque

from pyspark.sql import functions as F

from lattica.operators.closure import chains, closure, liveness


def bfs(seeds, edges):
    depth, queue = {s: 0 for s in seeds}, deque(seeds)
    while queue:
        x = queue.popleft()
        for a, b in edges:
            if a == x and b not in depth:
                depth[b] = depth[x] + 1
                queue.append(b)
    return depth


def test_depths_against_breadth_first_search(spark):
    edges = [(i, i + 1) for i in range(11)] + [(11, 0), (2, 9), (3, 3), (20, 21), (5, 30), (30, 31), (31, 5)]
    seeds = [0, 30]
    got = {r.node: r.depth for r in closure(spark.createDataFrame([(s,) for s in seeds], "node long"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == bfs(seeds, edges)


def test_groups_close_on_their_own_and_seeds_without_edges_stay(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    seeds = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "g string, node long")
    got = {(r.g, r.node) for r in closure(seeds, edges, "g").collect()}
    assert got == {("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3), ("c", 9)}


def test_more_groups_than_a_word_has_bits(spark):
    """150 groups in three words, the sign bit among them, on a ring: each group reaches each node at its own distance."""
    n = 10
    edges = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long")
    seeds = spark.createDataFrame([(f"g{g}", g % n) for g in range(150)], "g string, node long").coalesce(1)
    got = [(r.g, r.node, r.depth) for r in closure(seeds, edges, "g").collect()]
    assert len(got) == len(set(got)) and set(got) == {(f"g{g}", i, (i - g) % n) for g in range(150) for i in range(n)}


def test_closure_sends_no_table_through_the_driver(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % 200).alias("dst"))
    plan = closure(spark.range(3).select(F.col("id").alias("node")), edges)
    assert liveness(spark.range(200).withColumnRenamed("id", "rowid"), spark.range(3).withColumnRenamed("id", "node"), edges).where("state = 'live'").count() == plan.count()
    shown = liveness(spark.range(200).withColumnRenamed("id", "rowid"), spark.range(3).withColumnRenamed("id", "node"), edges)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in shown


def test_chain_taper_stops_and_cycles(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 7)] + [(1, 0), (1, 7), (1, 8), (1, 9), (2, 50)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    got = {(r.depth, r.src, r.dst, r.omitted) for r in chains(seeds, edges, 2, 4, spark.createDataFrame([(2,)], "node long")).collect()}
    assert got == {(1, 0, 1, 2), (1, 0, 2, 2), (1, 0, 3, 2), (1, 0, 4, 2), (2, 1, 0, 2), (2, 1, 7, 2)}


def test_callbacks_of_many_targets_go_on_in_few_rows(spark, monkeypatch):
    """70 targets of one parameter, through a ring of three: a round writes two rows of bits a parameter, not a row for each target."""
    from lattica.operators import dispatch

    sizes, write = [], dispatch.materialize
    monkeypatch.setattr(dispatch, "materialize", lambda df, name: (out := write(df, name), sizes.append(out.count()) if name == "callbacks" else None)[0])
    passed = spark.createDataFrame([(0, 0, t) for t in range(70)] + [(5, 1, 1), (5, 1, None)], "callee long, place int, target int").coalesce(1)
    forwarded = spark.createDataFrame([(i, 0, (i + 1) % 3, 0) for i in range(3)] + [(5, 1, 0, 0)], "callee long, place int, to long, to_place int")
    got = [tuple(r) for r in dispatch.bind_callbacks(passed, forwarded).collect()]
    want = {(c, 0, t) for c in range(3) for t in [*range(70), None]} | {(5, 1, 1), (5, 1, None)}
    assert len(got) == len(set(got)) and set(got) == want and max(sizes) <= 6
