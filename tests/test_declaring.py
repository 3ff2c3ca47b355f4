from __future__ import annotations

import json

from pyspark.sql import functions as F

from lattica.operators.manifests import read_manifests, select_manifests
from lattica.operators.stages import cached_stage
from lattica.operators.termini import external_termini, origins

TABLES = {"meta": {"id": "net"}, "classes": [{"id": "link", "keys": [{"id": "speed", "type": "u8", "default": 4, "helpers": True}, {"type": "u8"}, {"id": "speed", "type": "u9"}]}, {"id": "bare"}, 7]}
SPACES = {"namespace": "io", "classes": [{"name": "pin", "data": [{"name": "mode", "type": {"mem": "u1", "default": {"a": 1}}, "enum_set": {}}, {"name": ""}, 3]}, {"data": [{"name": "free"}]}]}


def manifests(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return read_manifests(docs, "k", "t")


def test_documents_are_told_apart_by_shape(spark):
    texts = [json.dumps(TABLES), json.dumps(SPACES), '["NET_LINK_SPEED", "X1"]', '["net"]', "[]", '["A", 3]', "{", "", None, "null", "7", '{"classes": []}', '{"classes": {"id": 1}}', '{"namespace": "x", "classes": [{"keys": []}]}', '{"classes": [{"id": "a", "keys": []}]}']
    got = [r["shape"] for r in sorted(manifests(spark, texts).select("manifest", "shape").collect())]
    assert got == ["tables", "spaces", "key_list", "other", "other", "other", "malformed", "malformed", "malformed", "other", "other", "other", "other", "other", "tables"]


def test_keys_of_listed_manifests(spark):
    texts = [json.dumps(TABLES), json.dumps(SPACES), '["NET_LINK_SPEED", "X1"]', json.dumps(TABLES)]
    observed = spark.createDataFrame([("NET_LINK_SPEED",), ("NET_LINK_SPEED",)], "define_name string")
    keys, states = select_manifests(manifests(spark, texts), observed)
    got = sorted((r.manifest, r.define_name, r.value_type, r.default_value, r.helpers, r.listed, r.observed) for r in keys.collect())
    assert got == [(k, "NET_LINK_SPEED", "u8", "4", True, True, True) for k in (0, 3)]
    assert sorted((r.manifest, r.state, r.n_keys) for r in states.collect()) == [(0, "selected", 1), (1, "unlisted", 2), (2, "key_list", 0), (3, "selected", 1)]


def test_fields_that_vary_by_build_are_named(spark):
    texts = [json.dumps(SPACES), '["IO_PIN_MODE"]']
    keys, _ = select_manifests(manifests(spark, texts), spark.createDataFrame([], "define_name string"))
    got = sorted((r.define_name, r.class_name, r.value_type, r.default_value, r.unresolved, r.listed) for r in keys.collect())
    assert got == [("IO_PIN_MODE", "pin", "u1", None, "default,enum_set", True), ("IO__FREE", "", None, None, None, False)]


def test_no_manifests(spark):
    keys, states = select_manifests(manifests(spark, []), spark.createDataFrame([], "define_name string"))
    assert keys.count() == states.count() == 0


def test_termini(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    # 1 <- 2 <- 3 (outside); 1 <- 9 (outside, nearer); 4 <- 5 <- 4 (a cycle); 6 by null only; 7 <- 8, which is given a function
    forwarded = frame([(1, 2), (2, 3), (1, 9), (1, 9), (4, 5), (5, 4), (7, 8), (3, 3), (None, 1)], "slot long, by long")
    registered = frame([("a", 1), ("a", 1), ("c", 4), ("n", 6), ("b", 7), ("m", 2), ("m", 7), ("u", 2)], "name string, slot long")
    invoked = frame([("a", 100), ("a", 100), ("a", 101), ("c", 1), ("n", 1), ("b", 1), ("m", 1)], "name string, invoker long")
    got = external_termini(registered, invoked, frame([(8,)], "slot long"), forwarded)
    assert sorted(map(tuple, got.collect())) == [("a", 100, 1, 9, 1, [1, 9], 2), ("a", 101, 1, 9, 1, [1, 9], 2)]
    assert sorted(map(tuple, origins(registered.where("name = 'c'"), forwarded).collect())) == [(4, 4, 0, [4]), (4, 5, 1, [4, 5])]
    assert external_termini(registered.limit(0), invoked, frame([(8,)], "slot long"), forwarded).count() == 0


def test_long_chains_of_forwards(spark):
    chain = spark.range(40).select(F.col("id").alias("slot"), (F.col("id") + 1).alias("by"))
    start = spark.createDataFrame([("x", 0)], "name string, slot long")
    got = external_termini(start, start.select("name", F.col("slot").alias("invoker")), start.select("slot").limit(0), chain).first()
    assert (got.terminus, got.depth, got.path) == (40, 40, list(range(41)))


def test_stage_results_are_reused_and_verified(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    rows = lambda pairs: spark.createDataFrame(pairs, "k int, t string").withColumn("digest", F.sha2("t", 256))
    compute = lambda given: given.select("k", F.length("t").alias("size"), F.lit(None).cast("string").alias("note"))
    run = lambda pairs, version="1", **options: sorted((r.k if r.k is not None else -1, r["size"], r.reused) for r in cached_stage(rows(pairs), "k", "digest", compute, path, version, options).collect())
    assert run([(1, "a"), (2, "bb"), (None, "ccc"), (4, None)]) == [(-1, 3, False), (1, 1, False), (2, 2, False), (4, None, False)]
    assert run([(1, "a"), (2, "bbb"), (3, "")]) == [(1, 1, True), (2, 3, False), (3, 0, False)]
    assert run([(1, "a"), (2, "bb"), (None, "ccc"), (4, None)]) == [(-1, 3, False), (1, 1, True), (2, 2, True), (4, None, False)]
    assert run([(1, "a")], version="2") == [(1, 1, False)]
    assert run([(1, "a")], width=3) == [(1, 1, False)] and run([(1, "a")], width=3) == [(1, 1, True)]
    assert run([]) == []
    # a stored size that somebody changed does not count
    stored = spark.read.parquet(path).where("k = 1").withColumn("size", F.lit(9))
    stored.coalesce(1).write.mode("overwrite").partitionBy("version", "config", "run").parquet(f"{path}-changed")
    assert all(size == 1 for _, size, _ in run([(1, "a")]))
    changed = f"{path}-changed"
    got = cached_stage(rows([(1, "a")]), "k", "digest", compute, changed, "2", {}).collect()
    assert [(r["size"], r.reused) for r in got] == [(1, False)]
    again = cached_stage(rows([(1, "a")]), "k", "digest", compute, changed, "2", {}).collect()
    assert [(r["size"], r.reused) for r in again] == [(1, True)]


def test_drafts_come_back_as_entries(spark):
    from lattica.operators.report import activated, drafted

    sections = spark.createDataFrame([("locks", "proposed"), ("keys", "no_candidates"), ("odd", "report_only")], "section string, status string")
    entries = spark.createDataFrame([("locks", "b", "2"), ("locks", "a", "#> 1"), ("odd", "c", "#> 3"), ("gone", "d", "4")], "section string, key string, value string")
    draft = drafted(sections, entries)
    assert sorted(map(tuple, draft.collect())) == [("keys", 0, "# keys: no_candidates"), ("locks", 0, "# locks: proposed"), ("locks", 1, "#> a: #> 1"), ("locks", 2, "#> b: 2"), ("odd", 0, "# odd: report_only"), ("odd", 1, "#  c: #> 3")]
    assert sorted(map(tuple, activated(draft).collect())) == [("locks", 1, "a: #> 1"), ("locks", 2, "b: 2")]


def test_excerpts_end_at_the_terminator(spark):
    from lattica.operators.answers import declaration_excerpt

    rows = spark.createDataFrame([(0, "a\nb;\nc", 1), (1, "a\nb\nc\nd;", 1), (2, "a\nb", 2), (3, "a", 5), (4, None, 1), (5, "", 0)], "k int, t string, at int")
    excerpt, last, cut = declaration_excerpt(F.col("t"), F.col("at"), 3)
    got = sorted(map(tuple, rows.select("k", excerpt, last, cut).collect()))
    assert got == [(0, "a\nb;", 2, False), (1, "a\nb\nc", 3, True), (2, "b", 2, False), (3, None, None, None), (4, None, None, None), (5, "", 1, False)]


def test_metrics_are_appended_in_their_columns(spark, tmp_path):
    import pytest

    from lattica.sources.sinks import append_metrics

    path = f"file://{tmp_path}/metrics"
    append_metrics(spark.createDataFrame([("a", 1)], "name string, n int"), path)
    append_metrics(spark.createDataFrame([(2, "b,c")], "n int, name string"), path)
    assert sorted(map(tuple, spark.read.option("header", True).csv(path).select("name", "n").collect())) == [("a", "1"), ("b,c", "2")]
    with pytest.raises(ValueError):
        append_metrics(spark.createDataFrame([(2,)], "n int"), path)


def test_versions_and_report_lines(spark):
    from lattica.functions.scalars import extract_version, report_line

    rows = spark.createDataFrame([('<simplesect kind="version"><para> 1.2 x</para>',), ('<simplesect kind="version"><para> </para>',), (None,), ("a|b",)], "t string")
    assert [r[0] for r in rows.select(extract_version(F.col("t"))).collect()] == ["1.2", "", "", ""]
    assert rows.select(report_line(F.col("t"), F.lit(1))).collect()[3][0] == "| a\\|b | 1 |"


def test_a_common_word_brings_no_query_together_with_all_names(spark):
    from lattica.operators.answers import emptiness

    names = spark.createDataFrame([(f"n{i}", "common") for i in range(50)] + [("x", "common rare"), ("y", "rare only")], "name string, text string")
    asked = spark.createDataFrame([("common rare",), ("common",), ("rare nowhere",), ("only common",), ("nowhere",)], "query string")
    got = {r["query"]: (r.n_found, r.grade) for r in emptiness(asked, names, names.limit(0)).collect()}
    assert got == {"common rare": (1, "answered"), "common": (51, "answered"), "rare nowhere": (0, "missing_word"), "only common": (0, "conjunction"), "nowhere": (0, "definitive")}


def test_a_list_without_names_that_is_cut_short_is_malformed(spark, tmp_path):
    """Order 707 lists names, has none, and is one of those cut short: its document was the two characters of an empty list."""
    import duckdb

    from lattica.plans.catalogue import ORACLES, QUERIES

    line = [(k, n, 1, 1, float(q), 0.0, 0.0, "A", "O") for k, n, q in ((707, 1, 1), (11, 1, 1), (19, 1, 9), (303, 1, 2), (404, 1, 9), (8, 1, 9))]
    spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(r[0], 3, "1-URGENT") for r in line], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    for t in ("lineitem", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = {(r.manifest, r["shape"], r.state, r.n_keys) for r in QUERIES["manifest_states"](spark, str(tmp_path)).collect()}
    assert (707, "malformed", "malformed", 0) in got and (11, "other", "other", 0) in got and got == set(duck.execute(ORACLES["manifest_states"]).fetchall())


def test_lines_of_a_class_are_collected_once(spark):
    """One list of each class and one of each order; a list for each form carried all lines twice through the aggregation."""
    from lattica.plans.declaring import _manifest_texts

    plan = _manifest_texts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 2 and "collect_set(" not in plan
