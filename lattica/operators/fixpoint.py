"""Conventions that spread along forwarded arguments, revised until they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

#: Rounds of a run: a bound of the declared semantics, since answers that are taken back need not settle.
MOST_ROUNDS = 8
#: What a kind is where definitions disagree.
WITHHELD = "unknown"
_FIELDS = ["name", "place", "label", "kind", "via", "conflicts"]


def evidence(passes: DataFrame, known: DataFrame) -> DataFrame:
    """(name, places, place, label, kind, via, conflicts): what all calls of a name say together, against all that is known.

    ``passes``: (name, callee, own map<int, int>): at which of its own places a definition takes what it hands to the callee's.
    Fields are judged apart: several entry places leave ``place`` null, disagreeing kinds or label places only that field.
    """
    target = known.select(F.col("name").alias("callee"), "place", "label", "kind")
    met = passes.join(target, "callee").select("name", "callee", "kind", F.col("own")[F.col("place")].alias("own_place"), F.col("own")[F.col("label")].alias("own_label"))
    held = met.where("own_place is not null").groupBy("name").agg(
        F.array_sort(F.collect_set("own_place")).alias("at"),
        F.array_sort(F.collect_set(F.coalesce("own_label", F.lit(-1)))).alias("labels"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.collect_set("callee")).alias("via"),
    )
    one = lambda c: F.size(c) == 1
    kind = F.when(one("kinds"), F.col("kinds")[0]).otherwise(WITHHELD)
    told = F.array_compact(F.array(F.when(kind == WITHHELD, "kind"), F.when(~one("labels"), "label")))
    return held.select(
        "name",
        F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("places"),
        F.when(one("at"), F.col("at")[0]).alias("place"),
        F.when(one("labels") & (F.col("labels")[0] >= 0), F.col("labels")[0]).alias("label"),
        kind.alias("kind"),
        F.array_join(F.transform("via", lambda x: x.cast("string")), ",").alias("via"),
        F.array_join(told, ",").alias("conflicts"),
    )


def derive_revising(seeds: DataFrame, passes: DataFrame, most_rounds: int | None = MOST_ROUNDS) -> DataFrame:
    """(name, place, label, kind, via, conflicts, places, state): conventions derived from seeds, with what was refused.

    Each round collects all evidence against all that is known, then applies it: a name with one entry place is known by its
    newest evidence, one with several is refused and leaves what is known, however early it had been answered. ``state``:

    - ``seed``: given; calls of its own do not change it;
    - ``derived``: the last evidence gives one place;
    - ``unsupported``: derived once, but what it rested on has been taken back since and nothing else speaks for it;
    - ``refused``: evidence of several ``places``; the other fields are null.

    It ends when a round changes nothing, after ``most_rounds``, or (with None) when a state comes again.
    ``seeds``: (name, place, label, kind); a null label takes no part. Rows with a null name or callee say nothing.
    """
    given = seeds.where("name is not null").select("name", F.col("place").cast("int").alias("place"), F.col("label").cast("int").alias("label"), "kind", F.lit("").alias("via"), F.lit("").alias("conflicts"))
    given = materialize(given.dropDuplicates(["name"]), "seeds")
    passes = materialize(passes.where("name is not null and callee is not null").join(given.select("name"), "name", "left_anti"), "passes")
    known, refused = given, given.limit(0).select("name", F.lit("").alias("places"))
    last, seen, before, n = given.limit(0).select("name"), set(), None, 0
    while most_rounds is None or n < most_rounds:
        n += 1
        said = materialize(evidence(passes, known), "evidence")
        known = materialize(known.join(said.select("name"), "name", "left_anti").select(_FIELDS).unionByName(said.where("place is not null").select(_FIELDS)), "known")
        refused = materialize(refused.join(said.select("name"), "name", "left_anti").unionByName(said.where("place is null").select("name", "places")), "refused")
        last = said.select("name")
        state = tuple(known.agg(F.count("*"), F.bit_xor(F.xxhash64(*_FIELDS))).first())
        # what is known decides all evidence, so the same again changes nothing; without a bound, nor does a state that recurs
        if state == before or most_rounds is None and state in seen:
            break
        before = state
        seen.add(state)
    heard = last.withColumn("heard", F.lit(True))
    told = known.join(given.select("name", F.lit(True).alias("given")), "name", "left").join(heard, "name", "left")
    told = told.withColumn("state", F.when(F.col("given"), "seed").when(F.col("heard"), "derived").otherwise("unsupported"))
    none = refused.select("name", *[F.lit(None).cast(t).alias(c) for c, t in (("place", "int"), ("label", "int"), ("kind", "string"), ("via", "string"), ("conflicts", "string"))], "places", F.lit("refused").alias("state"))
    return told.withColumn("places", F.col("place").cast("string")).select(*_FIELDS, "places", "state").unionByName(none)
