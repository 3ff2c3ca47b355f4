"""What a name is: one keyed probe of all relations that name things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of probing.
KINDS = ("function", "macro", "variable", "class", "thread", "lock", "key", "requirement")


def corpus(parts: list[DataFrame]) -> DataFrame:
    """(name, kind, rowid, is_def, brief): the relations under one another; a relation without a column has it null."""
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part, allowMissingColumns=True)
    return found


def resolve(asked: DataFrame, named: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(name, kind, also, n_sites, site, brief, miss): a row for each distinct asked name.

    The first of ``kinds`` under which a name is filed is its kind, and ``also`` lists the later ones in order. ``site`` is that
    kind's row to show, definitions before declarations, then the smallest id; ``brief`` the first one any of its rows carries in
    that order, so a name documented only where it is declared is documented. A miss is ``absent``, or ``undescribed: ...`` with
    the kinds that the name has but that are not described. Null names resolve to nothing and are left out.

    The relations meet the asked names in one join by name; a name's rows are reduced to a handful of values before the shuffle.
    """
    rank = F.lit(None).cast("int")
    for i, kind in enumerate(kinds):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    order = F.struct((~F.coalesce("is_def", F.lit(False))).alias("later"), F.col("rowid"))
    rows = named.where("name is not null and kind is not null").withColumn("rank", rank)
    by_kind = rows.groupBy("name", "kind", "rank").agg(
        F.count("*").alias("n_sites"), F.min(order).alias("site"), F.min(F.when(F.col("brief") != "", F.struct(order.alias("at"), "brief"))).alias("told")
    )
    by_name = by_kind.groupBy("name").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "kind", "n_sites", "site", "told")))).alias("known"),
        F.array_sort(F.collect_set(F.when(F.col("rank").isNull(), F.col("kind")))).alias("others"),
    )
    best = F.try_element_at("known", F.lit(1))
    names = asked.where("name is not null").select("name").distinct()
    return names.join(by_name, "name", "left").select(
        "name",
        best["kind"].alias("kind"),
        F.when(best.isNotNull(), F.array_join(F.transform(F.slice("known", F.lit(2), F.lit(len(kinds))), lambda x: x["kind"]), ",")).alias("also"),
        best["n_sites"].alias("n_sites"),
        best["site"]["rowid"].alias("site"),
        best["told"]["brief"].alias("brief"),
        F.when(best.isNotNull(), None).when(F.size(F.coalesce("others", F.array().cast("array<string>"))) > 0, F.concat(F.lit("undescribed: "), F.array_join("others", ","))).otherwise("absent").alias("miss"),
    )
