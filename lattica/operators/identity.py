"""Names and what they stand for: qualified identity, canonical row, candidates, overloads, name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def qualified(definition: Column, name: Column) -> Column:
    """The last blank-separated token of a definition that is the name or ends with it after ``:`` or ``.``; else the name."""
    tokens = F.filter(F.split(definition, r"\s+"), lambda t: (t == name) | t.endswith(F.concat(F.lit(":"), name)) | t.endswith(F.concat(F.lit("."), name)))
    return F.coalesce(F.element_at(F.when(F.size(tokens) > 0, tokens), -1), name)


def at_boundary(text: Column, needle: str) -> Column:
    """Whether ``needle`` occurs with no identifier character on either side."""
    import re

    return F.rlike(text, F.lit(rf"(^|[^A-Za-z0-9_]){re.escape(needle)}([^A-Za-z0-9_]|$)"))


def canonical(vertices: DataFrame) -> DataFrame:
    """(name, rowid, is_def): of the functions of each name, a defining row before others, then the lowest id."""
    first = F.min(F.struct((~F.col("is_def")).alias("late"), F.col("rowid"))).alias("first")
    return vertices.where("kind = 'function'").groupBy("name").agg(first, F.count("*").alias("n_rows")).select("name", F.col("first.rowid").alias("rowid"), (~F.col("first.late")).alias("is_def"), "n_rows")


def candidates(vertices: DataFrame) -> DataFrame:
    """(name, n_rows, n_identities, n_definitions, overloaded)."""
    own = vertices.withColumn("q", qualified(F.col("definition"), F.col("name")))
    counts = own.groupBy("name").agg(F.count("*").alias("n_rows"), F.countDistinct("q").alias("n_identities"), F.countDistinct("definition").alias("n_definitions"))
    return counts.withColumn("overloaded", F.col("n_definitions") > 1)


def definition_preferring(vertices: DataFrame) -> DataFrame:
    """(name, rowid): all defining rows of a name if it has any, else all its rows."""
    any_def = vertices.groupBy("name").agg(F.max("is_def").alias("any_def"))
    return vertices.join(any_def, "name").where("is_def = any_def").select("name", "rowid")


def resolve_names(sites: DataFrame, vertices: DataFrame) -> DataFrame:
    """(site, name, qualifier, n, rowid, match): how a written name resolves.

    One candidate whose definition has the qualifier (or a bare name's only candidate) is resolved; one candidate of a
    name with an unknown receiver is receiver_unverified; several are ambiguous, none is external, both without a row.
    ``sites``: (site, name, qualifier), the qualifier null for bare names.
    """
    # what a name and qualifier find is the same at each site, and what a definition says the same for each of its rows
    own = vertices.where("kind = 'function'").groupBy("name", "definition").agg(F.count("rowid").alias("rows"), F.min("rowid").alias("rowid"))
    written = sites.groupBy("site", "name", "qualifier").agg(F.count("*").alias("times"))
    asked = written.select("name", "qualifier").distinct()
    met = asked.where("name is not null").join(own, "name")
    fits = F.col("qualifier").isNull() | F.contains("definition", F.concat(F.col("qualifier"), F.lit("::")))
    told = met.groupBy("name", "qualifier").agg(F.sum("rows").alias("n"), F.sum(F.when(fits, F.col("rows")).when(~fits, 0)).alias("n_fit"), F.min("rowid").alias("only"), F.min(F.when(fits, F.col("rowid"))).alias("fit"))
    told = told.withColumnsRenamed({"name": "of", "qualifier": "by"})
    found = written.join(told, (F.col("name") == F.col("of")) & F.col("qualifier").eqNullSafe(F.col("by")), "left")
    found = found.withColumn("n_fit", F.when(F.col("n").isNull(), 0).otherwise(F.col("n_fit")) * F.col("times")).withColumn("n", F.coalesce("n", F.lit(0)) * F.col("times"))
    match = F.when(F.col("n_fit") == 1, "resolved").when(F.col("n") == 0, "external").when((F.col("n") == 1) & (F.col("n_fit") == 0), "receiver_unverified").otherwise("ambiguous")
    row = F.when(match == "resolved", F.col("fit")).when(match == "receiver_unverified", F.col("only"))
    return found.select("site", "name", "qualifier", "n", row.alias("rowid"), match.alias("match"))
