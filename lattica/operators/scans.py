"""Scans and declarations: titles, assignments, watched words, repaired bytes, live bindings, what-if runs, capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repaired(text: Column, most: int) -> Column:
    """The first ``most`` UTF-8 bytes of a text; a character cut apart at the end becomes U+FFFD."""
    return repaired_bytes(F.substring(F.encode(text, "UTF-8"), 1, most))


def repaired_bytes(data: Column) -> Column:
    """Bytes of any length as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def census(rows: DataFrame, key: str, text: str, watched: list[str]) -> DataFrame:
    """(key, word, n): occurrences of each watched word; a plain containment test passes over texts without any of them."""
    low = rows.select(key, F.lower(text).alias("low"))
    some = low.where(" or ".join(f"contains(low, '{w}')" for w in watched))
    found = some.select(key, F.explode(F.regexp_extract_all("low", F.lit(f"({'|'.join(watched)})"), F.lit(1))).alias("word"))
    return found.groupBy(key, "word").agg(F.count("*").alias("n"))


def live_bindings(rows: DataFrame) -> DataFrame:
    """(name, target, grade): bindings on branches that are not known to be dead; a name with none keeps its dead ones as fuzzy.

    ``rows``: (name, target, branch), branch true, false or null. One grouping decides each pair, another each name.
    """
    pairs = rows.groupBy("name", "target").agg(F.bool_or(F.coalesce("branch", F.lit(True))).alias("live"))
    names = pairs.groupBy("name").agg(F.bool_or("live").alias("any_live"))
    both = pairs.join(names, "name").where("live or not any_live")
    return both.select("name", "target", F.when(F.col("live"), "resolved").otherwise("fuzzy").alias("grade"))


def what_if(rows: DataFrame, now: Column, then: Column, group: str) -> DataFrame:
    """(group, n_kept, n_added, n_removed): what another pattern would select, in one pass over the same rows."""
    own, other = F.coalesce(now, F.lit(False)), F.coalesce(then, F.lit(False))
    one = lambda c: F.sum(c.cast("int"))
    return rows.groupBy(group).agg(one(own & other).alias("n_kept"), one(~own & other).alias("n_added"), one(own & ~other).alias("n_removed"))


def union_by_key(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """``first``, and the rows of ``second`` whose key it does not have."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti").select(first.columns))


def longest(rows: DataFrame, group: str, text: str, name: str, most: int) -> DataFrame:
    """The ``most`` longest texts of each group, by length and then name; ranks keep few rows a task before they meet."""
    order = Window.partitionBy(group).orderBy(F.length(text).desc(), name, text)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def capped_names(rows: DataFrame, group: str, name: str, most: int) -> DataFrame:
    """(group, n_names, names): how many distinct names, and the first few of them, joined by commas."""
    distinct = rows.select(group, name).distinct()
    sizes = distinct.groupBy(group).agg(F.count("*").alias("n_names"))
    few = distinct.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(name))).where(F.col("k") <= most)
    return few.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("names")).join(sizes, group)


def stated(entries: Column) -> Column:
    """A declaration's text: one ``key: value`` line for each entry of a map that has a value, by key."""
    pairs = F.filter(F.map_entries(entries), lambda e: e["value"].isNotNull())
    return F.array_join(F.array_sort(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def direction(word: Column, names: dict[str, list[str]]) -> Column:
    """The direction that a word stands for, null (refused) for any other."""
    low, found = F.lower(F.trim(word)), F.lit(None).cast("string")
    for way, words in names.items():
        found = F.when(low.isin(words), way).otherwise(found)
    return found
