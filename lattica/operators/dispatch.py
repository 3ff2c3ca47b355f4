"""Calls through interfaces, callbacks and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize
from lattica.operators.closure import MERGE
from lattica.operators.edges import strongest


def crossed(edges: DataFrame, overrides: DataFrame, grades: dict[str, int], sources: tuple[str, ...]) -> DataFrame:
    """(src, dst, via, grade): callers of an overridden node times its overrides, with the best incoming grade.

    Resolved where the node has one override and the incoming edge is not fuzzy, else fuzzy. ``overrides``: (child, parent).
    """
    incoming = strongest(edges, ["src", "dst"], grades, sources).select("src", F.col("dst").alias("parent"), F.col("grade").alias("incoming"))
    counts = overrides.groupBy("parent").agg(F.count("*").alias("n"))
    both = incoming.join(overrides.join(counts, "parent"), "parent").where("src <> child")
    grade = F.when((F.col("n") == 1) & (F.col("incoming") != "fuzzy"), "resolved").otherwise("fuzzy")
    return both.select("src", F.col("child").alias("dst"), F.col("parent").alias("via"), grade.alias("grade"))


def bind_callbacks(passed: DataFrame, forwarded: DataFrame) -> DataFrame:
    """(callee, place, target): what may stand behind each parameter, through functions that forward their own.

    ``passed``: (callee, place, target) of concrete arguments; ``forwarded``: (callee, place, to, to_place): ``callee`` hands its
    parameter ``place`` to ``to`` at ``to_place``. It ends when a round finds nothing new, as it must: what can be found is finite.
    """
    # targets are numbered and kept as bits, 64 in a row of a parameter: what is new of it goes on in one row, whatever its number
    names = materialize(passed.select("target").distinct().withColumn("id", F.monotonically_increasing_id()), "callback-targets")
    forwarded = materialize(forwarded.select("callee", "place", "to", "to_place").distinct(), "callback-forwards")
    keys = ["callee", "place", "word"]
    given = passed.join(names.withColumnRenamed("target", "name"), F.col("target").eqNullSafe(F.col("name")))
    given = given.select("callee", "place", F.shiftright("id", 6).alias("word"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bits"))
    found = materialize(given.groupBy(*keys).agg(F.bit_or("bits").alias("bits")), "callbacks")
    fresh = found
    parts = 1
    while not fresh.isEmpty():
        made = fresh.join(forwarded.hint("merge"), ["callee", "place"]).groupBy(F.col("to").alias("callee"), F.col("to_place").alias("place"), "word").agg(F.bit_or("bits").alias("bits"))
        none = F.lit(0).cast("long")
        both = found.select(*keys, F.col("bits").alias("old"), none.alias("new")).unionByName(made.select(*keys, none.alias("old"), F.col("bits").alias("new")))
        new = both.groupBy(*keys).agg(F.bit_or("old").alias("old"), F.bit_or("new").alias("new")).select(*keys, F.col("new").bitwiseAND(F.bitwise_not("old")).alias("bits"))
        fresh = materialize(new.where("bits <> 0"), "callbacks")
        found, parts = found.unionByName(fresh), parts + 1
        if parts == MERGE:
            found, parts = materialize(found, "callbacks"), 1
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0))
    members = found.select("callee", "place", "word", bit.alias("bit")).select("callee", "place", (F.shiftleft("word", 6) + F.col("bit")).alias("id"))
    return members.join(names, "id").select("callee", "place", "target")


def topic_roles(roles: DataFrame) -> DataFrame:
    """(topic, role, rowid): distinct emitters and handlers, definitions preferred by name.

    ``roles``: (topic, role, name, rowid, is_def), role emit or handle.
    """
    some = roles.groupBy("topic", "role", "name").agg(F.max("is_def").alias("any_def"))
    return roles.join(some, ["topic", "role", "name"]).where("is_def = any_def").select("topic", "role", "rowid").distinct()


def topic_edges(roles: DataFrame) -> DataFrame:
    """(topic, emitter, handler): emitters times handlers of a topic; ``roles`` as for ``topic_roles``."""
    own = topic_roles(roles)
    emit = own.where("role = 'emit'").select("topic", F.col("rowid").alias("emitter"))
    return emit.join(own.where("role = 'handle'").select("topic", F.col("rowid").alias("handler")), "topic")
