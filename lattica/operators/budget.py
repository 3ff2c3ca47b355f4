"""Answers within a byte budget: nested rows shrunk in place, with a count of what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of one row at most; each removes a ring or half a list.
MOST_STEPS = 64


def shrink(rows: DataFrame, key: str, lists: list[str], budget: int, most_steps: int = MOST_STEPS) -> DataFrame:
    """(key, nodes, hops, *lists, rings, halvings, left_out, n_bytes): rows whose JSON of key, nodes, hops and lists fits, where it can.

    ``nodes``: array<struct<name, depth>>; ``hops``: array<struct<from, to>>; ``lists``: columns of arrays. While a row is too
    long, its outermost ring goes: all nodes of the largest depth, and every hop that touches a name no longer there. A ring of
    depth 1 stays. After that the longest list (of equal ones the first) loses its later half, down to one element, so an answer
    may stay above a budget that is smaller than its skeleton. ``left_out`` counts nodes, hops and elements that went. Arrays
    that are null count as empty.

    A row's loop is one fold within the row: no shuffle, and nothing leaves the JVM. The depths of a hop's ends are found once, so
    a step passes over each array once; a row that fits or cannot shrink is done, and later steps do not look at it.
    """
    columns = ["nodes", "hops", *lists]
    fields = [*columns, "deepest", "rings", "halvings", "done"]

    def plain(state: Column, c: str) -> Column:
        return F.transform(state[c], lambda h: h["hop"]) if c == "hops" else state[c]

    def size(state: Column, of_key: Column) -> Column:
        return F.octet_length(F.to_json(F.struct(of_key.alias(key), *[plain(state, c).alias(c) for c in columns])))

    def total(state: Column) -> Column:
        return sum((F.size(state[c]) for c in columns), F.lit(0))

    def with_parts(state: Column, **parts: Column) -> Column:
        return F.struct(*[parts.get(c, state[c]).alias(c) for c in fields])

    def depth_of(nodes: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(nodes, lambda n: n["depth"])), F.lit(0))

    def located(nodes: Column, hops: Column) -> Column:
        """Hops with the least depth of each end, null where it is no node."""
        known = F.filter(nodes, lambda n: n["depth"].isNotNull() & n["name"].isNotNull())
        ordered = F.array_sort(F.transform(known, lambda n: F.struct(n["depth"].alias("depth"), n["name"].alias("name"))))
        at = lambda o, name: F.get(o["depth"], F.array_position(o["name"], name).cast("int") - 1)
        # an array of one, so that the lists are made once and not for each hop
        return F.transform(F.array(ordered), lambda o: F.transform(F.array(F.struct(o["depth"].alias("depth"), o["name"].alias("name"))), lambda x: F.transform(hops, lambda h: F.struct(h.alias("hop"), at(x, h["from"]).alias("a"), at(x, h["to"]).alias("b"))))[0])[0]

    def step(state: Column, _: Column) -> Column:
        inner = F.filter(state["nodes"], lambda n: n["depth"] < state["deepest"])
        within = F.filter(state["hops"], lambda h: (h["a"] < state["deepest"]) & (h["b"] < state["deepest"]))
        shorter = with_parts(state, nodes=inner, hops=within, deepest=depth_of(inner), rings=state["rings"] + 1)
        longest = F.greatest(*[F.size(state[c]) for c in lists]) if len(lists) > 1 else F.size(state[lists[0]])
        done = with_parts(state, done=F.lit(True))
        halved = done
        for c in reversed(lists):
            half = with_parts(state, **{c: F.slice(state[c], F.lit(1), F.greatest((F.size(state[c]) / 2).cast("int"), F.lit(1))), "halvings": state["halvings"] + 1})
            halved = F.when(F.size(state[c]) == longest, half).otherwise(halved)
        return F.when(state["done"], state).when(size(state, F.col(key)) <= budget, done).when(state["deepest"] > 1, shorter).when(longest > 1, halved).otherwise(done)

    own = rows.select(key, *[F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in columns])
    parts = [located(F.col("nodes"), F.col("hops")).alias("hops") if c == "hops" else F.col(c) for c in columns]
    start = F.struct(*parts, depth_of(F.col("nodes")).alias("deepest"), F.lit(0).alias("rings"), F.lit(0).alias("halvings"), F.lit(False).alias("done"))
    folded = own.select(key, total({c: F.col(c) for c in columns}).alias("before"), F.aggregate(F.sequence(F.lit(1), F.lit(most_steps)), start, step).alias("after"))
    after = F.col("after")
    return folded.select(key, *[plain(after, c).alias(c) for c in columns], "after.rings", "after.halvings", (F.col("before") - total(after)).alias("left_out"), size(after, F.col(key)).alias("n_bytes"))
