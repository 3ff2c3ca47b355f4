"""Changes between snapshots: file deltas, staleness, content cache, the session pressure counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): unchanged, modified, added or removed."""
    both = before.select(key, F.col(digest).alias("old"), F.lit(True).alias("was")).join(after.select(key, F.col(digest).alias("new"), F.lit(True).alias("now")), key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return both.select(key, change.alias("change"))


def from_cache(wanted: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows found in the cache, keys that must be made anew)."""
    return wanted.join(cache, key), wanted.join(cache.select(*key).distinct(), key, "left_anti")


def merkle_digest(files: DataFrame, group: str, path: str, digest: str, bucket: int = 4096) -> DataFrame:
    """(group, digest): SHA-256 over the digests of hash buckets of a group's files, each over its sorted paths and digests.

    A group of n files has n / ``bucket`` buckets, dealt by the first 32 bits of their path's MD5, so no task holds a whole large
    group. Files without a group are a group of their own; those without a path are not told apart by it.
    """
    sizes = files.groupBy(F.col(group).alias("of")).agg(F.ceil(F.count("*") / bucket).alias("buckets"))
    line = F.concat_ws(":", path, digest)
    dealt_by = F.conv(F.substring(F.md5(F.coalesce(F.col(path).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    dealt = files.join(sizes, F.col(group).eqNullSafe(F.col("of"))).select(group, (dealt_by % F.col("buckets")).alias("bucket"), line.alias("line"))
    inner = dealt.groupBy(group, "bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("h"))
    return inner.groupBy(group).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))


def pressure(events: DataFrame, session: str, order: list[str], search: Column, use: Column) -> DataFrame:
    """``events`` with searches, uses, pressure and due: cumulative searches minus three times cumulative uses.

    Judged on searches only: silent below 5, due at multiples of 5 up to 19, always due from 20. There is no floor.
    """
    so_far = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("searches", F.sum(search.cast("int")).over(so_far)).withColumn("uses", F.sum(use.cast("int")).over(so_far)).withColumn("pressure", F.col("searches") - 3 * F.col("uses"))
    return counted.withColumn("due", search & is_due(F.col("pressure")))


def is_due(level: Column) -> Column:
    return (level >= 5) & ((level % 5 == 0) | (level >= 20))
