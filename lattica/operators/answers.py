"""Answers about subjects: why one is empty, where else a name stands, source slices, members, declared rows, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and ``#``."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9#]+"), lambda t: t != ""))


def emptiness(asked: DataFrame, searched: DataFrame, unread: DataFrame) -> DataFrame:
    """(query, n_found, grade, n_missing, n_unread): every query's answer, and what an empty one means.

    A query finds the names of ``searched`` (name, text) that hold all its words. An empty answer is ``conjunction`` where
    each word occurs but no name holds all, ``missing_word`` where some do not, ``unread_corpus`` where a row of ``unread``
    (name, text), which is not searched, holds all of them, and ``definitive`` where a query of one word is nowhere.
    A query first meets the names of its rarest word, and each of these is then asked for by (word, name), so that a word that
    is everywhere brings no query together with the whole corpus.
    """
    wanted = asked.select("query", F.explode(words(F.col("query"))).alias("word"))
    sizes = wanted.groupBy("query").agg(F.count("*").alias("n_words"))

    def hits(corpus: DataFrame) -> DataFrame:
        own = corpus.select("name", F.explode(words(F.concat_ws(" ", "name", "text"))).alias("word")).distinct()
        many = wanted.join(own.groupBy("word").agg(F.count("*").alias("names")), "word", "left").fillna(0, ["names"])
        rarest = many.groupBy("query").agg(F.min(F.struct("names", "word")).alias("m")).select("query", F.col("m.word").alias("word"))
        near = rarest.join(own, "word").select("query", "name")
        return near.join(wanted, "query").join(own, ["word", "name"]).groupBy("query", "name").agg(F.count("*").alias("n"))

    def whole(found: DataFrame, name: str) -> DataFrame:
        return found.join(sizes, "query").where("n = n_words").groupBy("query").agg(F.count("*").alias(name))

    seen = wanted.join(searched.select(F.explode(words(F.concat_ws(" ", "name", "text"))).alias("word")).distinct(), "word").groupBy("query").agg(F.count("*").alias("n_seen"))
    both = sizes.join(whole(hits(searched), "n_found"), "query", "left").join(whole(hits(unread), "n_unread"), "query", "left").join(seen, "query", "left").fillna(0)
    missing = F.col("n_words") - F.col("n_seen")
    grade = F.when(F.col("n_found") > 0, "answered").when(F.col("n_unread") > 0, "unread_corpus").when(F.col("n_words") == 1, "definitive").when(missing > 0, "missing_word").otherwise("conjunction")
    return both.select("query", "n_found", grade.alias("grade"), missing.alias("n_missing"), "n_unread")


def also_in(rows: DataFrame, name: str, place: str, order: str, most: int = 5) -> DataFrame:
    """(name, first row's order and place, n_places, also_in): the first row of a name, and up to ``most`` other places.

    Places are counted before any list is made, and only the first few of each name are listed.
    """
    from pyspark.sql import Window

    first = rows.groupBy(name).agg(F.min(F.struct(order, place)).alias("first"), F.countDistinct(place).alias("n_places"))
    own = rows.select(name, place).distinct().join(first.select(name, F.col(f"first.{place}").alias("own")), name).where(F.col(place) != F.col("own"))
    few = own.withColumn("k", F.row_number().over(Window.partitionBy(name).orderBy(place))).where(F.col("k") <= most)
    listed = few.groupBy(name).agg(F.array_join(F.sort_array(F.collect_list(place)), ",").alias("also_in"))
    return first.join(listed, name, "left").select(name, F.col(f"first.{order}").alias(order), F.col(f"first.{place}").alias(place), "n_places", F.coalesce("also_in", F.lit("")).alias("also_in"))


def source_slice(text: Column, lo: Column, hi: Column, most: int) -> tuple[Column, Column]:
    """(lines ``lo`` to ``hi`` of a text, at most ``most`` of them; how many lines were left out), lines counted from 1."""
    lines = F.slice(F.split(text, "\n"), F.greatest(lo, F.lit(1)), F.greatest(hi - F.greatest(lo, F.lit(1)) + 1, F.lit(0)))
    return F.array_join(F.slice(lines, F.lit(1), F.lit(most)), "\n"), F.greatest(F.size(lines) - most, F.lit(0))


def declaration_excerpt(text: Column, start: Column, most: int, ends: str = ";") -> tuple[Column, Column, Column]:
    """(lines from ``start`` to the first that holds ``ends``, last line's number, whether ``most`` lines came before any did).

    Lines count from 1; all three are null where the text is or has no such line. A terminator inside a string ends it too early.
    """
    window = F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.lit(most))
    found = F.array_position(F.transform(window, lambda x: F.contains(x, F.lit(ends))), F.lit(True))
    size = F.when(found > 0, found.cast("int")).when(F.size(window) > 0, F.size(window))
    return F.array_join(F.slice(window, F.lit(1), size), "\n"), F.greatest(start, F.lit(1)) + size - 1, F.when(size.isNotNull(), (found == 0) & (size == most))


def hierarchy(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(class, base, n_own, n_inherited, n_derived): members of each class, of its base, and classes derived from it.

    ``classes``: (class, base), one level at a time; ``members``: (class, member).
    """
    own = members.groupBy("class").agg(F.countDistinct("member").alias("n_own"))
    derived = classes.where("base is not null").groupBy(F.col("base").alias("class")).agg(F.count("*").alias("n_derived"))
    above = own.select(F.col("class").alias("base"), F.col("n_own").alias("n_inherited"))
    return classes.join(own, "class", "left").join(above, "base", "left").join(derived, "class", "left").fillna(0, ["n_own", "n_inherited", "n_derived"]).select("class", "base", "n_own", "n_inherited", "n_derived")


def first_pattern(name: Column, patterns: list[tuple[str, str]]) -> Column:
    """The key of the first pattern that a name matches: a prefix is taken off, a shell pattern gives the whole name."""
    from lattica.operators.text import glob_pattern

    found = F.lit(None).cast("string")
    for label, pattern in reversed(patterns):
        if "*" in pattern or "?" in pattern:
            own, key = F.rlike(name, F.lit(glob_pattern(pattern))), name
        else:
            own, key = F.startswith(name, F.lit(pattern)), F.substring(name, len(pattern) + 1, F.length(name))
        found = F.when(own, F.concat(F.lit(label + ":"), key)).otherwise(found)
    return found


def topic(raw: Column) -> Column:
    """A topic's normal form: lower case, runs of other characters as one dot, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "."), r"^\.+|\.+$", "")


def sidecar_coverage(rows: DataFrame, sidecars: DataFrame, key: str, group: str) -> DataFrame:
    """(group, n, n_covered, coverage, bytes_covered): rows with a sidecar, and the bytes of their texts.

    Sidecars are reduced to one row a key, so repeats do not count twice.
    """
    have = sidecars.select(key).distinct().withColumn("have", F.lit(1))
    both = rows.join(have, key, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    size = F.sum(F.when(F.col("have") == 1, F.octet_length("text")).otherwise(0)).cast("long")
    return both.groupBy(group).agg(F.count("*").alias("n"), F.sum("have").cast("long").alias("n_covered"), F.round(F.avg("have"), 4).alias("coverage"), size.alias("bytes_covered"))


def phrase(text: Column, query: str) -> Column:
    """Whether the words of a query that is no valid search stand next to each other, in order."""
    parts = [t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split() if t]
    return F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" ")), F.lit(f" {' '.join(parts)} "))
