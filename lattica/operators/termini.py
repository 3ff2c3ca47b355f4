"""Where forwarded parameters leave the code: chains of functions that hand their own parameter on and are bound by nobody."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

#: Rounds whose results are read as one union before they are written as one table.
MERGE_EVERY = 16


def origins(slots: DataFrame, forwarded: DataFrame) -> DataFrame:
    """(slot, at, depth, path): every parameter whose value may reach each slot, by a shortest chain of forwards.

    ``slots``: (slot); ``forwarded``: (slot, by): some call hands parameter ``by`` of its caller on to ``slot``. Depth 0 is the slot
    itself; of shortest paths the least stays. Each parameter is met once a slot, so that cycles end.
    """
    start = slots.where("slot is not null").select("slot").distinct()
    fresh = materialize(start.select("slot", F.col("slot").alias("at"), F.lit(0).cast("long").alias("depth"), F.array("slot").alias("path")), "origins")
    hops = materialize(forwarded.where("slot is not null and by is not null and slot <> by").select(F.col("slot").alias("at"), "by").distinct(), "forwards")
    found, rounds = fresh, 0
    while not fresh.isEmpty():
        made = fresh.join(hops, "at").groupBy("slot", "by").agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
        made = made.select("slot", F.col("by").alias("at"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("by")).alias("path"))
        fresh = materialize(made.join(found.select("slot", "at"), ["slot", "at"], "left_anti"), "origins")
        found, rounds = found.unionByName(fresh), rounds + 1
        if rounds % MERGE_EVERY == 0:
            found = materialize(found, "origins")
    return found


def external_termini(registered: DataFrame, invoked: DataFrame, concrete: DataFrame, forwarded: DataFrame) -> DataFrame:
    """(name, invoker, registered_by, terminus, depth, path, n_termini): invocations whose target comes from outside.

    ``registered``: (name, slot), parameters that are stored under a name; ``invoked``: (name, invoker); ``concrete``: (slot),
    parameters that some call gives a known function; ``forwarded``: as for ``origins``. A name is bound if any parameter whose
    value may reach it is given a known function. Of the others, one whose chain ends in a parameter that no call here
    gives anything has its terminus there; one that nothing is forwarded to (only null is ever stored) has none. Each
    invoker has one row, with its name's nearest terminus, the least path among equals, and the number of termini.
    """
    reach = origins(registered, forwarded)
    bound = concrete.select("slot").distinct()
    given = bound.unionByName(forwarded.where("slot <> by").select("slot")).distinct()
    resolved = reach.join(bound.withColumnRenamed("slot", "at"), "at", "left_semi").select("slot").distinct()
    ends = reach.where("depth > 0").join(given.withColumnRenamed("slot", "at"), "at", "left_anti")
    own = registered.where("name is not null").select("name", "slot").distinct()
    free = own.join(own.join(resolved, "slot").select("name").distinct(), "name", "left_anti")
    named = free.join(ends, "slot").groupBy("name").agg(F.min(F.struct("depth", "path", "slot", "at")).alias("m"), F.countDistinct("at").alias("n_termini"))
    named = named.select("name", F.col("m.slot").alias("registered_by"), F.col("m.at").alias("terminus"), F.col("m.depth").alias("depth"), F.col("m.path").alias("path"), "n_termini")
    return invoked.select("name", "invoker").distinct().join(named, "name").select("name", "invoker", "registered_by", "terminus", "depth", "path", "n_termini")
