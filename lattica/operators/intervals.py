"""Points and intervals: containment, overlap, nesting, attribution to what came before.

Joins go by (holder, level, bucket of the axis), an equi-join, and the exact range is tested on what meets. Buckets are twice
as wide at each level, and an interval is filed at the first level where it touches at most two, however long it is; one that
is open at its end reaches to the last point of its holder. A point is looked up at the levels that its holder has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(at: Column, width: int, level: Column) -> Column:
    return F.floor(at / (F.lit(width) * F.pow(F.lit(2.0), level)))


def _filed(spans: DataFrame, last: DataFrame, width: int) -> DataFrame:
    """Spans with a level and their one or two buckets there, up to their end or the last of their holder's points."""
    ends = spans.join(last, "holder").withColumn("end", F.greatest(F.least(F.coalesce("hi", "last"), F.col("last")), F.col("lo")))
    length = F.greatest((F.col("end") - F.col("lo")) / width, F.lit(1.0))
    leveled = ends.withColumn("level", F.ceil(F.log2(length)).cast("int"))
    touched = F.sequence(_bucket(F.col("lo"), width, F.col("level")), _bucket(F.col("end"), width, F.col("level")))
    return leveled.withColumn("bucket", F.explode(touched)).drop("last", "end")


def contained(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """(point, holder, at, section, lo, hi): each point with each span of its holder that contains it, ends included."""
    last = points.groupBy("holder").agg(F.max("at").alias("last"))
    filed = _filed(spans, last, width)
    levels = filed.groupBy("holder").agg(F.collect_set("level").alias("levels"))  # at most the logarithm of the longest span
    looked = points.join(levels, "holder").withColumn("level", F.explode("levels")).drop("levels")
    met = looked.withColumn("bucket", _bucket(F.col("at"), width, F.col("level"))).join(filed, ["holder", "level", "bucket"])
    return met.where("at >= lo and (hi is null or at <= hi)").drop("level", "bucket")


def enclosing(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """(point, section): the smallest section that contains a point, null where none does."""
    found = contained(points, spans, width).groupBy("point").agg(F.min("section").alias("section"))
    return points.select("point").join(found, "point", "left")


def uncovered(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Points that no span of their holder contains."""
    return points.join(contained(points, spans, width).select("point").distinct(), "point", "left_anti")


def overlap_grades(wanted: DataFrame, given: DataFrame, drift: int, width: int) -> DataFrame:
    """(section, grade): hit where an own span of ``given`` overlaps within ``drift``, holder_only, or missed."""
    reach = wanted.where("hi is not null").withColumn("bucket", F.explode(F.sequence(F.floor((F.col("lo") - drift) / width), F.floor((F.col("hi") + drift) / width))))
    filed = given.where("hi is not null").select("holder", F.col("lo").alias("g_lo"), F.col("hi").alias("g_hi")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("g_lo") / width), F.floor(F.col("g_hi") / width))))
    hits = reach.join(filed, ["holder", "bucket"]).where((F.col("g_lo") - drift <= F.col("hi")) & (F.col("g_hi") + drift >= F.col("lo"))).select("section").distinct().withColumn("hit", F.lit(1))
    holders = given.select("holder").distinct().withColumn("known", F.lit(1))
    both = wanted.select("section", "holder").join(hits, "section", "left").join(holders, "holder", "left")
    return both.select("section", F.when(F.col("hit") == 1, "hit").when(F.col("known") == 1, "holder_only").otherwise("missed").alias("grade"))


def nestings(spans: DataFrame, width: int) -> DataFrame:
    """(outer_section, inner_section, holder): a closed span strictly inside another one of its holder."""
    inner = spans.where("hi is not null").select(F.col("section").alias("point"), "holder", F.col("lo").alias("at"), F.col("hi").alias("inner_hi"))
    met = contained(inner, spans, width)
    return met.where("section <> point and lo < at and (hi is null or inner_hi < hi)").select(F.col("section").alias("outer_section"), F.col("point").alias("inner_section"), "holder")


def last_before(events: DataFrame, group: str, order: list[str], marks: Column, value: str) -> DataFrame:
    """``events`` with ``before``: the value of the latest marked row before each one in its group (as-of backward)."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("before", F.last(F.when(marks, F.col(value)), ignorenulls=True).over(before))


def paired_duration(starts: DataFrame, stops: DataFrame, key: str, group: str) -> DataFrame:
    """(group, n_pairs, total): summed time from start to stop of the same key, negative ones as 0, null without a pair."""
    pairs = starts.select(group, key, F.col("at").alias("begun")).join(stops.select(key, F.col("at").alias("ended")), key)
    sums = pairs.groupBy(group).agg(F.count("*").alias("n_pairs"), F.sum(F.greatest(F.col("ended") - F.col("begun"), F.lit(0))).alias("total"))
    return starts.select(group).distinct().join(sums, group, "left").select(group, F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "total")


def covering(spans: DataFrame, line: int) -> DataFrame:
    """(file, n_covering, n_unplaceable): spans of each file around a line; those without an end cannot be placed."""
    inside = (F.col("lo") <= line) & (F.col("hi") >= line) & (F.col("hi") > 0)
    return spans.groupBy("file").agg(F.sum(inside.cast("int")).alias("n_covering"), F.sum((F.col("hi") == 0).cast("int")).alias("n_unplaceable"))
