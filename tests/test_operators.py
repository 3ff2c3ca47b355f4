from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import edges, identity, intervals, report, rosters, text


def test_scalar_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    words = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    assert get(S.brief(F.lit("a  b\n c"))) == "a b c"
    assert get(S.brief(F.lit("ab " * 100), 10)) == "ab ab ab…" and get(S.brief(F.lit("x" * 30), 10)) == "x" * 10 + "…"
    assert get(S.without_prefix(F.lit("CONFIG_"), ("CONFIG_",))) == "CONFIG_" and get(S.without_prefix(F.lit("CONFIG_A"), ("X", "CONFIG_"))) == "A"
    assert get(S.carried(F.lit(None).cast("array<string>"), words("a"))) == ["a"] and get(S.carried(words(), words("a"))) is None and get(S.carried(words("b"), words("a"))) == ["b"]
    assert get(S.layered(words(), words("d"), words("f"), words("x", "d"))) == ["x", "d"]
    assert get(S.redacted(F.lit("at /home/me/x and /tmp/y/z now"))) == "at <home>/x and <tmp> now"
    assert get(S.looks_like_test(F.lit("Test_a"), F.lit("src"))) and not get(S.looks_like_test(F.lit("a"), F.lit("src")))
    assert get(text.matches_glob(F.lit("a/b/c.py"), "*.py")) and not get(text.matches_glob(F.lit("a/b/c.py"), "?.c"))
    assert get(text.strip_markup(F.lit("<p>a <b>b</b>\n c</p>"))) == "a b c"
    guard = lambda *v: F.array(*[F.lit(x).cast("boolean") for x in v])
    assert get(report.all_true(guard(True, None))) is None and get(report.all_true(guard(None, False))) is False and get(report.any_true(guard(None, True))) is True


def test_first_writer_keeps_rows_with_null_keys(spark):
    rows = spark.createDataFrame([(1, "k", 2, "late"), (1, "k", 1, "early"), (1, None, 3, "x"), (1, None, 4, "y")], "a int, b string, seq int, v string")
    assert sorted(r.v for r in edges.first_writer(rows, ["a", "b"], "seq").collect()) == ["early", "x", "y"]


def test_qualified_identity(spark):
    rows = spark.createDataFrame([("int ns::f", "f"), ("f int", "f"), ("void m.f g", "f"), ("nothing", "f")], "definition string, name string")
    got = {r.definition: r.q for r in rows.withColumn("q", identity.qualified(F.col("definition"), F.col("name"))).collect()}
    assert got == {"int ns::f": "ns::f", "f int": "f", "void m.f g": "m.f", "nothing": "f"}


def water(claims, budget):
    """Max-min fair shares by filling up from the smallest claim."""
    shares, left, n = {}, budget, len(claims)
    for i, (claim, item) in enumerate(sorted((c, k) for k, c in claims.items())):
        shares[item] = min(claim, left / (n - i))
        left -= shares[item]
    return shares


def test_fair_shares_against_filling(spark):
    rng = random.Random(2)
    pools = {p: {i: rng.randrange(1, 60) for i in range(rng.randrange(1, 9))} for p in range(12)}
    rows = spark.createDataFrame([(p, i, c) for p, cs in pools.items() for i, c in cs.items()], "pool int, item int, claim int")
    got = {(r.pool, r.item): r.share for r in rosters.fair_shares(rows, "pool", "item", "claim", 100).collect()}
    want = {(p, i): round(x, 4) for p, cs in pools.items() for i, x in water(cs, 100).items()}
    assert got == want


def test_containment_against_all_pairs(spark):
    rng = random.Random(8)
    points = [(i, rng.randrange(3), rng.randrange(0, 1000)) for i in range(80)]
    spans = [(i, rng.randrange(3), lo := rng.randrange(0, 900), lo + rng.randrange(0, 300) if rng.random() < 0.8 else None) for i in range(40)]
    p, q = spark.createDataFrame(points, "point long, holder int, at long"), spark.createDataFrame(spans, "section long, holder int, lo long, hi long")
    want = {(a, s) for a, h, t in points for s, g, lo, hi in spans if h == g and lo <= t and (hi is None or t <= hi)}
    for width in (7, 100, 5000):
        assert {(r.point, r.section) for r in intervals.contained(p, q, width).collect()} == want
    inside = {a for a, _ in want}
    assert {r.point for r in intervals.uncovered(p, q, 50).collect()} == {a for a, *_ in points} - inside


def test_long_spans_have_few_copies(spark):
    spans = spark.createDataFrame([(1, 1, 3, 9_000_000), (2, 1, 0, None), (3, 1, 5, 2), (4, 1, None, 7)], "section long, holder int, lo long, hi long")
    points = spark.createDataFrame([(i, 1, at) for i, at in enumerate((0, 3, 5, 8_999_999, 9_000_000, 9_000_001))], "point long, holder int, at long")
    last = points.groupBy("holder").agg({"at": "max"}).toDF("holder", "last")
    assert intervals._filed(spans, last, 1).count() <= 6
    assert {(r.point, r.section) for r in intervals.contained(points, spans, 1).collect()} == {(p, 1) for p in range(1, 5)} | {(p, 2) for p in range(6)}


def test_two_hops_through_hubs(spark):
    rng = random.Random(4)
    some = [(rng.randrange(30), 99) for _ in range(60)] + [(99, rng.randrange(30)) for _ in range(60)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(80)]
    paths = Counter((a, d) for a, b in some for c, d in some if b == c and a != d)
    for hub_pairs in (1, 50, 10_000):
        got = {(r.src, r.dst): r.n_paths for r in edges.two_hop(spark.createDataFrame(some, "src long, dst long"), hub_pairs).collect()}
        assert got == paths


def test_dominated_against_pairs(spark):
    rng = random.Random(6)
    names = {i: (f"n{i % 4}", rng.choice(["q", f"q{i}", None])) for i in range(24)}
    some = {(rng.randrange(9), rng.randrange(24), rng.choice(["x", "y"]), rng.choice(["fuzzy", "firm"])) for _ in range(160)}
    over = [(rng.randrange(24), rng.randrange(24)) for _ in range(12)]
    want = {}
    for src, dst, source, grade in some:
        if grade == "fuzzy":
            anchors = [d for s, d, _, g in some if s == src and g == "firm" and names[d][0] == names[dst][0]]
            same = any(names[d][1] is not None and names[d][1] == names[dst][1] for d in anchors)
            crossing = any((d, dst) in over or (dst, d) in over for d in anchors)
            want[src, dst, source] = "unanchored" if not anchors else "same_identity" if same else "override" if crossing else "dominated"
    made = edges.dominated(
        spark.createDataFrame(sorted(some), "src long, dst long, source string, grade string"),
        spark.createDataFrame([(i, n, q) for i, (n, q) in names.items()], "rowid long, name string, qualified string"),
        spark.createDataFrame(over, "child long, parent long"),
    )
    assert {(r.src, r.dst, r.source): r.verdict for r in made.collect()} == want and len(set(want.values())) == 4


def test_key_pairs_suppress_products(spark):
    rows = [("small", "write", i) for i in range(4)] + [("small", "read", i) for i in range(16)] + [("big", "write", i) for i in range(5)] + [("big", "read", i) for i in range(13)]
    accesses = spark.createDataFrame(rows * 2, "key_name string, role string, participant int")
    pairs = edges.shared_key_pairs(accesses)
    assert pairs.count() == 64 and {r.key_name for r in pairs.collect()} == {"small"}
    assert [(r.key_name, r.writers, r.readers) for r in edges.shared_key_pairs(accesses, suppressed=True).collect()] == [("big", 5, 13)]


def test_merkle_digests_tell_any_change(spark):
    from lattica.operators.incremental import merkle_digest

    rows = [("a", f"p{i}", f"h{i}") for i in range(50)] + [("b", "p", "h")]
    made = lambda some: {r.g: r.digest for r in merkle_digest(spark.createDataFrame(some, "g string, p string, h string"), "g", "p", "h", bucket=8).collect()}
    base = made(rows)
    assert made(rows[::-1]) == base
    changed = made([("a", "p7", "other") if r[:2] == ("a", "p7") else r for r in rows])
    assert changed["a"] != base["a"] and changed["b"] == base["b"]


def test_a_name_of_many_rows_and_sites_resolves_without_their_pairs(spark):
    """20,000 sites and 20,000 rows of one name: 400 million pairs if each site met each row."""
    import time

    rows = spark.range(20_000).select(F.col("id").alias("rowid"), F.lit("hot").alias("name"), F.lit("function").alias("kind"), F.when(F.col("id") == 7, "A::hot").otherwise("B::hot").alias("definition"))
    rows = rows.unionByName(spark.createDataFrame([(-1, "one", "function", "C::one"), (-2, "one", "macro", "C::one")], rows.schema))
    sites = spark.range(20_000).select(F.col("id").alias("site"), F.lit("hot").alias("name"), F.when(F.col("id") % 3 == 1, "A").when(F.col("id") % 3 == 2, "B").alias("qualifier"))
    few = [(-1, "one", None), (-2, "one", "C"), (-3, "one", "D"), (-4, "none", "D"), (-5, None, None)]
    began = time.monotonic()
    got = {tuple(r) for r in identity.resolve_names(sites.unionByName(spark.createDataFrame(few, "site long, name string, qualifier string")), rows).collect()}
    assert time.monotonic() - began < 20
    hot = lambda i: ("hot", "A", 20_000, 7, "resolved") if i % 3 == 1 else ("hot", "B" if i % 3 == 2 else None, 20_000, None, "ambiguous")
    own = {(-1, "one", None, 1, -1, "resolved"), (-2, "one", "C", 1, -1, "resolved"), (-3, "one", "D", 1, -1, "receiver_unverified"), (-4, "none", "D", 0, None, "external"), (-5, None, None, 0, None, "external")}
    assert got == own | {(i, *hot(i)) for i in range(20_000)}
