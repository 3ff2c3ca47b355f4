from __future__ import annotations

import random
from collections import defaultdict

import pytest

from lattica.plans import linking
from lattica.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with 60 parts and 60 orders, and their firm edges by plain Python."""
    rng, folder = random.Random(5), str(tmp_path_factory.mktemp("tables"))
    parts = [(k, f"name{k}", "TYPE", f"Brand#{k % 4}", 50 if k % 20 == 1 else 49 if k % 20 == 2 else k % 40) for k in range(1, 61)]
    lines = [(o, n, rng.randint(1, 60), rng.randint(1, 5), float(rng.choice([5, 9, 10, 20, 44, 46, 50])), rng.choice("ANR"), rng.choice("OF")) for o in range(60) for n in range(1, rng.randint(2, 4))]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    first = {}
    for a, b in zip(lines, lines[1:], strict=False):
        if a[0] == b[0]:
            first.setdefault((a[2], b[2], a[5]), "fuzzy" if a[4] < 10 else "exact" if a[6] == "F" else "resolved")
    edges = {(s, t) for (s, t, _), grade in first.items() if grade != "fuzzy" and s != t}
    exact = {(s, t, source) for (s, t, source), grade in first.items() if grade == "exact" and s != t}
    large = {(a[2], b[2]) for a, b in zip(lines, lines[1:], strict=False) if a[0] == b[0] and a[4] > 45 and a[2] != b[2]}
    assert large < edges
    return folder, parts, edges, exact


def reach(seeds, edges):
    seen, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def rows(spark, name, folder):
    got = [tuple(r) for r in QUERIES[name](spark, folder).collect()]
    assert len(got) == len(set(got))
    return set(got)


def walk(seeds, edges):
    out, found = defaultdict(list), set()
    for a, b in sorted(edges):
        out[a].append(b)
    for seed in seeds:
        expanded, frontier = {seed}, {seed}
        for depth in (1, 2, 3):
            cap, nexts = max(4 >> (depth - 1), 1), set()
            for a in frontier:
                for b in out[a][:cap]:
                    found.add((seed, depth, a, b, max(len(out[a]) - cap, 0)))
                    nexts.add(b)
            frontier = nexts - expanded
            expanded |= frontier
    return found


def test_liveness_hops_and_chains(spark, tables):
    folder, parts, edges, exact = tables
    seeds = [p[0] for p in parts if p[4] == 50]
    live = reach(seeds, edges)
    kind = {p[0]: "function" if p[4] <= 40 else "variable" if p[4] <= 45 else "macro" for p in parts}
    assert rows(spark, "reachability_liveness", folder) == {(p[0], "live" if p[0] in live else "orphan") for p in parts}
    hops = defaultdict(list)
    for a, b in edges:
        for c, e in edges:
            if b == c and a != e and (kind[a], kind[b], kind[e]) == ("function", "macro", "function"):
                hops[a, e].append(b)
    assert rows(spark, "macro_hop_edges", folder) == {(a, b, min(v), len(v)) for (a, b), v in hops.items()}
    assert rows(spark, "chain_forward", folder) == walk(seeds, edges)
    assert rows(spark, "chain_backward", folder) == walk(seeds, {(b, a) for a, b in edges})


def test_macro_hops_deduplicate_only_edges_of_macros(spark, tables, monkeypatch):
    """All edges were deduplicated, once for each of the two hops."""
    folder, parts, edges, exact = tables
    seen, first_writer = [], linking.E.first_writer

    def counted(rows, key, seq):
        seen.append({(r.src, r.dst) for r in rows.collect()})
        return first_writer(rows, key, seq)

    monkeypatch.setattr(linking.E, "first_writer", counted)
    assert rows(spark, "macro_hop_edges", folder)
    kind = {p[0]: "function" if p[4] <= 40 else "variable" if p[4] <= 45 else "macro" for p in parts}
    assert len(seen) == 1 and {e for e in edges if {kind[e[0]], kind[e[1]]} == {"function", "macro"}} <= seen[0]
    assert all({kind[a], kind[b]} == {"function", "macro"} for a, b in seen[0])


def test_threads_over_all_firm_edges(spark, tables):
    folder, parts, edges, exact = tables
    threads = {t: reach([p[0] for p in parts if p[3] == t and p[4] >= 49], edges) for t in {p[3] for p in parts if p[4] >= 49}}
    of = defaultdict(set)
    for t, nodes in threads.items():
        for n in nodes:
            of[n].add(t)
    assert rows(spark, "thread_membership", folder) == {(t, n) for t, nodes in threads.items() for n in nodes}
    assert rows(spark, "thread_roster", folder) == {(t, len(nodes), min(nodes)) for t, nodes in threads.items()}
    assert rows(spark, "multi_thread_members", folder) == {(n, len(t)) for n, t in of.items() if len(t) > 1}
    got = {(r.src, r.dst): (r.crosses, r.to_group) for r in QUERIES["thread_boundaries"](spark, folder).collect()}
    assert got == {(a, b): (not of[a] & of[b] if of[a] and of[b] else None, min(of[b]) if len(of[b]) == 1 else None) for a, b in edges}
