"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

#: Rounds after which a run counts as broken; star contractions need about the logarithm of the longest path.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link to another one.

    ``links`` is undirected; repeats, both directions and self-links may occur, links with a null end are ignored. Nothing
    but a count and a checksum of each round reaches the driver, and each round is written to the shared folder.
    """
    ends = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b")))
    edges, before = materialize(ends.distinct(), name), None
    for _ in range(MOST_ROUNDS):
        edges = materialize(_small_star(_large_star(edges)), name)
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
