"""Paired comparisons and roll-ups of measured cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_ratios(cells: DataFrame, pair: str, arm: str, value: str, a: str, b: str, group: str) -> DataFrame:
    """(group, n_pairs, geomean, cv, median) of value(a) / value(b) over pairs that have both, values above 0."""
    own = cells.where(F.col(value) > 0).groupBy(group, pair).agg(F.avg(F.when(F.col(arm) == a, F.col(value))).alias("x"), F.avg(F.when(F.col(arm) == b, F.col(value))).alias("y"))
    r = own.where("x is not null and y is not null").withColumn("r", F.col("x") / F.col("y"))
    return r.groupBy(group).agg(F.count("*").alias("n_pairs"), F.round(F.exp(F.avg(F.log("r"))), 4).alias("geomean"), F.round(F.stddev("r") / F.avg("r"), 4).alias("cv"), F.round(F.median("r"), 4).alias("median"))


def headroom(marks: DataFrame, first: Column, second: Column) -> DataFrame:
    """(n, p_first, p_second, p_first_given_not_second, p_second_given_not_first, p_union)."""
    one = lambda c: F.sum(c.cast("int"))
    share = lambda a, b: F.round(F.when(b > 0, a / b), 4)
    n = F.count("*")
    return marks.agg(
        n.alias("n"), share(one(first), n).alias("p_first"), share(one(second), n).alias("p_second"),
        share(one(first & ~second), one(~second)).alias("p_first_given_not_second"), share(one(second & ~first), one(~first)).alias("p_second_given_not_first"), share(one(first | second), n).alias("p_union"),
    )


def majority(votes: DataFrame, subject: str, label: str, seq: str) -> DataFrame:
    """(subject, label, n_votes, agreement): the most common label, of equal ones the one seen first."""
    counts = votes.groupBy(subject, label).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    best = counts.groupBy(subject).agg(F.max(F.struct("n", (-F.col("first")).alias("early"), F.col(label).alias("label"))).alias("b"), F.sum("n").alias("n_votes"))
    return best.select(subject, F.col("b.label").alias(label), "n_votes", F.round(F.col("b.n") / F.col("n_votes"), 4).alias("agreement"))


def last_attempt(rows: DataFrame, cell: list[str], seq: list[str], keep: list[str]) -> DataFrame:
    """The last row of each cell."""
    best = rows.groupBy(*cell).agg(F.max(F.struct(F.struct(*seq).alias("seq"), F.struct(*keep).alias("kept"))).alias("b"))
    return best.select(*cell, *[F.col(f"b.kept.{c}").alias(c) for c in keep])


def cells(questions: DataFrame, arms: DataFrame, fenced: DataFrame, question: str) -> DataFrame:
    """Questions by arms without the fenced questions; ``arms`` is a short list by design, checked before it is sent."""
    n = arms.limit(1001).count()
    if n > 1000:
        raise ValueError("arms are a short list")
    return questions.join(fenced, question, "left_anti").crossJoin(F.broadcast(arms))


def segment_times(marks: DataFrame, group: str, order: list[str], at: str) -> DataFrame:
    """``marks`` with ``elapsed`` since the mark before in their group."""
    return marks.withColumn("elapsed", F.col(at) - F.lag(at).over(Window.partitionBy(group).orderBy(*order)))


def all_true(values: Column) -> Column:
    """Three-valued conjunction of an array: false wins over unknown, unknown over true, none is true."""
    return F.aggregate(values, F.lit(True), lambda a, x: a & x)


def any_true(values: Column) -> Column:
    """Three-valued disjunction of an array; none is false."""
    return F.aggregate(values, F.lit(False), lambda a, x: a | x)


#: What a drafted line starts with that its owner may make active.
MARKER = "#> "


def drafted(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """(section, place, line): a draft of each section, its status first, then its entries as marked lines in order of their keys.

    ``sections``: (section, status); ``entries``: (section, key, value). Each line is a row, so that no section is gathered. Entries
    of sections that are not ``proposed`` are shown without the marker: they are findings, not text to make active.
    """
    heads = sections.select("section", F.lit(0).cast("long").alias("place"), F.concat(F.lit("# "), "section", F.lit(": "), "status").alias("line"))
    order = Window.partitionBy("section").orderBy("key", "value")
    mark = F.when(F.col("status") == "proposed", MARKER).otherwise("#  ")
    body = entries.join(sections, "section").select("section", F.row_number().over(order).cast("long").alias("place"), F.concat(mark, "key", F.lit(": "), "value").alias("line"))
    return heads.unionByName(body)


def activated(draft: DataFrame) -> DataFrame:
    """(section, place, line): the marked lines of a draft without their marker; a marker within a line does not count."""
    return draft.where(F.startswith("line", F.lit(MARKER))).select("section", "place", F.substring("line", len(MARKER) + 1, 1 << 30).alias("line"))
