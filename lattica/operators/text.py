"""Text: ranked multi-corpus search, token hits, BM25 with widening, snippets, tags and markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

K1, B = 1.2, 0.75
#: Points of a name that is the query, contains it, and of each token in the name or the description.
EXACT, INSIDE, IN_NAME, IN_BRIEF = 1000, 200, 50, 5


def strip_markup(x: Column) -> Column:
    """Tags to blanks, white space to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


def tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9_]+"), lambda t: t != "")


def _has(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def search(corpus: DataFrame, query: str, most: int | None = 25) -> DataFrame:
    """(tier, name, score): rows in which every token occurs, in name or brief, best first; null ``most`` gives all."""
    parts = [t for t in query.lower().split() if t]
    every, score = F.lit(True), F.lit(0)
    for t in parts:
        every = every & (_has(F.col("name"), t) | _has(F.col("brief"), t))
        score = score + F.when(_has(F.col("name"), t), IN_NAME).otherwise(0) + F.when(_has(F.col("brief"), t), IN_BRIEF).otherwise(0)
    score = score + F.when(F.lower("name") == query.lower(), EXACT).otherwise(0) + F.when(_has(F.col("name"), query), INSIDE).otherwise(0)
    found = corpus.where(every).groupBy("tier", "name").agg(F.max(score).alias("score"))
    ordered = found.orderBy(F.col("score").desc(), "tier", "name")
    return ordered if most is None else ordered.limit(max(1, most))


def token_hits(corpus: DataFrame, query: str) -> DataFrame:
    """(token, n_names): distinct names that each token alone finds, in one pass over the corpus."""
    parts = sorted(set(query.lower().split()))
    counts = corpus.agg(*[F.countDistinct(F.when(_has(F.col("name"), t) | _has(F.col("brief"), t), F.col("name"))).alias(f"t{i}") for i, t in enumerate(parts)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"t{i}").alias("n_names")) for i, t in enumerate(parts)])).alias("x")).select("x.*")


def bm25(docs: DataFrame, id_col: str, text_col: str, query: list[str]) -> DataFrame:
    """(id, n_hit, score): BM25 of documents with any of the tokens; statistics over all documents, in one pass each.

    Only the query's tokens are counted in a text, so no posting of any other word is made.
    """
    parts = sorted({t.lower() for t in query})
    words = docs.select(F.col(id_col), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    is_token = lambda t: lambda x: x == t
    counted = words.select(id_col, F.size("w").alias("len"), *[F.size(F.filter("w", is_token(t))).alias(f"tf{i}") for i, t in enumerate(parts)])
    counted = materialize(counted, "bm25")  # lengths and counts only; texts are cut once
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(parts))])
    both = counted.crossJoin(F.broadcast(stats))  # one row of statistics
    score, hit = F.lit(0.0), F.lit(0)
    for i in range(len(parts)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        hit = hit + (tf > 0).cast("int")
    return both.select(id_col, hit.alias("n_hit"), F.round(score, 6).alias("score")).where("n_hit > 0")


def widened(scored: DataFrame, n_tokens: int) -> DataFrame:
    """Rows with all tokens; only if there are none, rows with any. Adds ``widened``."""
    most = scored.agg(F.max("n_hit").alias("most"))
    both = scored.crossJoin(F.broadcast(most))  # one row
    return both.where((F.col("most") < n_tokens) | (F.col("n_hit") == n_tokens)).withColumn("widened", F.col("most") < n_tokens).drop("most")


def snippet(text: Column, token: str, around: int = 8) -> Column:
    """Words around the first hit, the hit in brackets; null without one."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    at = F.array_position(F.transform(words, lambda w: F.lower(w)), F.lit(token.lower()))
    start = F.greatest(at - around, F.lit(1))
    cut = F.slice(words, start.cast("int"), F.lit(2 * around + 1))
    return F.when(at > 0, F.concat_ws(" ", F.transform(cut, lambda w: F.when(F.lower(w) == token.lower(), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))))


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell pattern; ``*`` crosses slashes."""
    import fnmatch

    return "^" + fnmatch.translate(glob).removeprefix("(?s:").replace(")\\z", "").replace(")\\Z", "") + "$"


def matches_glob(path: Column, glob: str) -> Column:
    """Whether the whole path, or its last segment, matches."""
    pattern = F.lit(glob_pattern(glob))
    return F.rlike(path, pattern) | F.rlike(F.element_at(F.split(path, "/"), -1), pattern)
