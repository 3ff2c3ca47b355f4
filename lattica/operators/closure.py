"""Closures over edge tables. Each round is written to the shared folder, so lineage and lost executors stay harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

#: Written rounds that are read apart at most.
MERGE = 16


def closure(seeds: DataFrame, edges: DataFrame, group: str | None = None) -> DataFrame:
    """(group, node, depth): nodes reachable from ``seeds`` with the smallest number of steps; seeds have depth 0.

    ``seeds``: (node) or, with ``group``, (group, node), each group closing on its own. Groups are numbered and kept as bits, 64 of
    them in a row of a node, so an edge is followed for all groups that reach it in the same round together. A round follows what
    is new of each node and is written once. It ends with an empty round, as nodes are finite; written rounds are merged whenever
    there are ``MERGE``, so long paths do not pile up files to read. No join is a broadcast: tables are larger than their files.
    """
    steps = materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).where("src <> dst").distinct(), "closure-edges")
    if group:
        # numbers are dense within a partition, so words are full but for the last one of each
        names = materialize(seeds.select(F.col(group).alias("group")).distinct().withColumn("id", F.monotonically_increasing_id()), "closure-groups")
        given = seeds.select(F.col(group).alias("group"), "node").join(names.withColumnRenamed("group", "name"), F.col("group").eqNullSafe(F.col("name")))
        given = given.select("node", F.shiftright("id", 6).alias("word"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bits"))
    else:
        given = seeds.select("node", F.lit(0).cast("long").alias("word"), F.lit(1).cast("long").alias("bits"))
    keys = ["node", "word"]
    fresh = materialize(given.groupBy(*keys).agg(F.bit_or("bits").alias("bits")).withColumn("depth", F.lit(0)), "closure")
    found, depth, parts = fresh, 0, 1
    while not fresh.isEmpty():
        depth += 1
        made = fresh.join(steps.hint("merge"), "node").groupBy(F.col("next").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        # old and new bits meet in one aggregation
        both = found.select(*keys, F.col("bits").alias("old"), F.lit(0).cast("long").alias("new")).unionByName(made.select(*keys, F.lit(0).cast("long").alias("old"), F.col("bits").alias("new")))
        new = both.groupBy(*keys).agg(F.bit_or("old").alias("old"), F.bit_or("new").alias("new")).select(*keys, F.col("new").bitwiseAND(F.bitwise_not("old")).alias("bits"))
        fresh = materialize(new.where("bits <> 0").withColumn("depth", F.lit(depth)), "closure")
        found, parts = found.unionByName(fresh), parts + 1
        if parts == MERGE:
            found, parts = materialize(found, "closure"), 1
    if not group:
        return found.select("node", "depth")
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0))
    members = found.select("node", "depth", "word", bit.alias("bit")).select("node", "depth", (F.shiftleft("word", 6) + F.col("bit")).alias("id"))
    return members.join(names, "id").select(F.col("group").alias(group), "node", "depth")


def liveness(vertices: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(rowid, state, depth): live if reachable from the seeds, else orphan."""
    live = closure(seeds, edges).withColumnRenamed("node", "rowid")
    return vertices.select("rowid").join(live.hint("merge"), "rowid", "left").select("rowid", F.when(F.col("depth").isNotNull(), "live").otherwise("orphan").alias("state"), F.col("depth").cast("long").alias("depth"))


def chains(seeds: DataFrame, edges: DataFrame, most_depth: int, fan_out: int, stops: DataFrame | None = None) -> DataFrame:
    """(seed, depth, src, dst, omitted): bounded walks, tapered by depth.

    From each node of a walk the first ``max(fan_out >> (depth - 1), 1)`` neighbours are followed in order; ``omitted`` tells
    how many were not. A node is expanded once for each seed, at its smallest depth; ``stops`` (node) are not expanded.
    """
    by_node = Window.partitionBy("seed", "src")
    edges = materialize(edges.select("src", "dst"), "chain-edges")
    frontier = seeds.select(F.col("node").alias("seed"), F.col("node").alias("src")).distinct()
    expanded, hops = frontier, None
    for depth in range(1, most_depth + 1):
        cap = max(fan_out >> (depth - 1), 1)
        if stops is not None:
            frontier = frontier.join(stops.select(F.col("node").alias("src")), "src", "left_anti")
        # only the first ``cap`` neighbours and their number are kept of a node, however many it has
        step = frontier.join(edges, "src").withColumn("place", F.row_number().over(by_node.orderBy("dst"))).withColumn("n", F.count("*").over(by_node))
        step = step.where(F.col("place") <= cap).select("seed", F.lit(depth).cast("long").alias("depth"), "src", "dst", F.greatest(F.col("n") - cap, F.lit(0)).alias("omitted"))
        step = materialize(step, "chain")
        hops = step if hops is None else hops.unionByName(step)
        frontier = step.select("seed", F.col("dst").alias("src")).distinct().join(expanded, ["seed", "src"], "left_anti")
        expanded = expanded.unionByName(frontier)
    return hops
