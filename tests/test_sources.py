from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from lattica.operators.incremental import delta, from_cache
from lattica.sources import files, sinks


def test_file_tree_and_delta(spark, tmp_path):
    for name, body in {"a/x.c": "int x;", "a/y.py": "y = 1", "build/z.c": "z", "top.c": "t"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    tree = files.file_tree(spark, str(tmp_path), ("build",))
    got = {r.path: r.sha256 for r in tree.collect()}
    assert set(got) == {"a/x.c", "a/y.py", "top.c"} and got["a/x.c"] == hashlib.sha256(b"int x;").hexdigest()
    assert {r.path for r in files.file_tree(spark, str(tmp_path), (), "*.c").collect()} == {"a/x.c", "build/z.c", "top.c"}
    roots = {r.path: r.root for r in files.owning_root(tree, ["a", "top.c", ""]).collect()}
    assert roots == {"a/x.c": "a", "a/y.py": "a", "top.c": "top.c"}
    old = spark.createDataFrame([("a/x.c", got["a/x.c"]), ("gone", "1"), ("top.c", "other")], "path string, sha256 string")
    assert {r.path: r.change for r in delta(old, tree, "path", "sha256").collect()} == {"a/x.c": "unchanged", "a/y.py": "added", "gone": "removed", "top.c": "modified"}
    hit, miss = from_cache(tree.select("path", "sha256"), old.withColumn("rows", F.lit(1)), ["path", "sha256"])
    assert [r.path for r in hit.collect()] == ["a/x.c"] and miss.count() == 2


def test_markdown_sections(spark, tmp_path):
    (tmp_path / "d.md").write_text("intro\n# One\nbody\n```\n# not a heading\n```\n## Two #\n\n### Empty\n")
    got = sorted((r.first_line, r.heading, r.body) for r in files.markdown_sections(files.text_lines(spark, str(tmp_path))).collect())
    assert got == [(1, "", "intro"), (2, "One", "body\n```\n# not a heading\n```"), (7, "Two", ""), (9, "Empty", "")]


def test_json_index(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"index": {"7": {"name": "f", "kind": "fn"}, "8": {"name": "S", "kind": "struct"}}}, indent=1))
    assert {(r.key, r.name, r.kind) for r in files.json_index(spark, str(tmp_path), "name string, kind string", "index").collect()} == {("7", "f", "fn"), ("8", "S", "struct")}


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.swap_table(spark.range(3), path)
    sinks.swap_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    a = spark.createDataFrame([("k", 1), ("l", 2)], "key string, v int")
    b = spark.createDataFrame([("l", 3)], "key string, v int")
    assert {tuple(r) for r in sinks.upsert(a, b, ["key"]).collect()} == {("k", 1), ("l", 3)}
    rows = spark.createDataFrame([("g", 1, "x", None), ("g", 2, "unknown", "y"), ("g", 3, "", "z" * 90)], "g string, i int, a string, b string")
    wired = rows.withColumn("body", sinks.wire_json(["i", "a", "b"]))
    assert [r.body for r in wired.orderBy("i").collect()][:2] == ['{"i":1,"a":"x"}', '{"i":2,"b":"y"}']
    assert [(r.i, r.left_out) for r in sinks.within_bytes(wired, "g", ["i"], "body", 40).orderBy("i").collect()] == [(1, 1), (2, 1)]


def test_published_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert sinks.current_version(spark, path) is None
    first = sinks.publish_table(spark.range(3), path)
    old = sinks.current_table(spark, path)
    assert old.count() == 3 and sinks.current_version(spark, path) == first
    second = sinks.publish_table(spark.range(5), path)
    assert sinks.current_table(spark, path).count() == 5 and old.count() == 3 and second != first
