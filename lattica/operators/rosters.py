"""Aggregates that describe a whole layer: distributions, rollups, coverage, rosters, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.storage import materialize


def distribution(rows: DataFrame, label: str) -> DataFrame:
    """(label, n): counts by label, null as the empty string."""
    return rows.groupBy(F.coalesce(F.col(label), F.lit("")).alias(label)).agg(F.count("*").alias("n"))


def row_inflation(edges: DataFrame) -> DataFrame:
    """(n_rows, n_pairs, inflation): rows for each distinct pair; pairs are counted before they are summed."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_pairs"), F.round(F.sum("n") / F.count("*"), 4).alias("inflation"))


def directory_rollup(paths: DataFrame) -> DataFrame:
    """(dir, n_files, n_symbols, external_rows, unresolved_rows, external_files): by the first segment of the path.

    The sums count symbol rows, as the join with symbols leaves them; ``external_files`` counts files once.
    """
    first = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(".")
    return paths.groupBy(first.alias("dir")).agg(
        F.countDistinct("path").alias("n_files"),
        F.countDistinct("symbol").alias("n_symbols"),
        F.sum(F.col("external").cast("int")).alias("external_rows"),
        F.sum(F.col("unresolved").cast("int")).alias("unresolved_rows"),
        F.countDistinct(F.when(F.col("external"), F.col("path"))).alias("external_files"),
    )


def origin_split(paths: DataFrame) -> DataFrame:
    """(path, origin, n): first_party if any row is, else external, else unresolved; a path counts once."""
    rank = F.when(~F.col("external") & ~F.col("unresolved"), 0).when(F.col("external"), 1).otherwise(2)
    best = paths.groupBy("path").agg(F.min(rank).alias("rank"))
    return best.groupBy(F.when(F.col("rank") == 0, "first_party").when(F.col("rank") == 1, "external").otherwise("unresolved").alias("origin")).agg(F.count("*").alias("n"))


def coverage(vertices: DataFrame, substantive: int) -> DataFrame:
    """(file, n_symbols, n_lines, substantive, barren): what a file yields; barren ones have one symbol at most."""
    files = vertices.groupBy("file").agg(F.countDistinct("name").alias("n_symbols"), F.sum("lines").alias("n_lines"))
    return files.withColumn("substantive", F.col("n_lines") >= substantive).withColumn("barren", F.col("substantive") & (F.col("n_symbols") <= 1))


def layer_states(layers: dict[str, DataFrame | None]) -> DataFrame:
    """(layer, state, n): populated, empty or absent."""
    out = None
    for name, rows in layers.items():
        if rows is None:
            spark = next(df.sparkSession for df in layers.values() if df is not None)
            one = spark.range(1).select(F.lit(name).alias("layer"), F.lit("absent").alias("state"), F.lit(0).cast("long").alias("n"))
        else:
            one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), F.when(F.col("n") > 0, "populated").otherwise("empty").alias("state"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def families(names: DataFrame, pattern: str, least_keys: int) -> DataFrame:
    """(prefix, n_keys, n_rows): names split by a pattern with groups prefix and key; families of several distinct keys."""
    split = names.select(F.regexp_extract("name", pattern, 1).alias("prefix"), F.regexp_extract("name", pattern, 2).alias("key")).where("prefix <> ''")
    return split.groupBy("prefix").agg(F.countDistinct("key").alias("n_keys"), F.count("*").alias("n_rows")).where(F.col("n_keys") >= least_keys)


def partner_pairs(names: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """(first, second): distinct names whose partner, by its last word, exists too."""
    own = names.select("name").distinct()
    swapped = F.lit(None).cast("string")
    for a, b in pairs:
        swapped = F.when(own["name"].endswith(a), F.concat(F.expr(f"substring(name, 1, length(name) - {len(a)})"), F.lit(b))).otherwise(swapped)
    made = own.withColumn("second", swapped).where("second is not null").withColumnRenamed("name", "first")
    return made.join(own.withColumnRenamed("name", "second"), "second", "left_semi").select("first", "second")


def boundaries(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, crosses, to_group): whether an edge leads out of all groups of its source.

    Null where either side has no group; ``to_group`` where the target has exactly one. ``members``: (node, group).
    """
    # few sets are those of many nodes: nodes carry the number of their set, and two sets are compared once
    sets = materialize(members.groupBy("node").agg(F.array_sort(F.collect_set("group")).alias("groups")), "group-sets")
    numbered = materialize(sets.select("groups").distinct().withColumn("id", F.monotonically_increasing_id()), "group-set-ids")
    own = sets.join(numbered, "groups").select("node", "id")
    of = lambda end, name: own.select(F.col("node").alias(end), F.col("id").alias(name)).hint("merge")
    both = materialize(edges.join(of("src", "a"), "src", "left").join(of("dst", "b"), "dst", "left").select("src", "dst", "a", "b"), "grouped-edges")
    met = both.where("a is not null and b is not null").select("a", "b").distinct()
    met = met.join(numbered.select(F.col("id").alias("a"), F.col("groups").alias("x")), "a").join(numbered.select(F.col("id").alias("b"), F.col("groups").alias("y")), "b")
    met = met.select("a", "b", (~F.arrays_overlap("x", "y")).alias("crosses"))
    lone = numbered.where(F.size("groups") == 1).select(F.col("id").alias("b"), F.get("groups", F.lit(0)).alias("to_group"))
    return both.join(met, ["a", "b"], "left").join(lone, "b", "left").select("src", "dst", "crosses", "to_group")


def exemplars(rows: DataFrame, keys: list[str], good: Column, order: str) -> DataFrame:
    """(keys, n_sites, n_good, exemplar): the first good site of each, else the first site."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_sites"), F.sum(good.cast("int")).alias("n_good"), F.min_by(order, F.struct((~good).alias("bad"), F.col(order).alias("o"))).alias("exemplar"))


def capped(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """``rows`` with their place and the total of their group, the first ``most`` of each."""
    own = Window.partitionBy(group)
    ranked = rows.withColumn("place", F.row_number().over(own.orderBy(*order))).withColumn("total", F.count("*").over(own))
    return ranked.where(F.col("place") <= most)


def fair_shares(claims: DataFrame, pool: str, item: str, claim: str, budget: int) -> DataFrame:
    """(pool, item, claim, share): max-min fair shares of a budget in each pool.

    Claims are served from the smallest; each gets its claim or an equal part of what is left among those still unserved,
    which is a running sum and a count of the sorted claims.
    """
    w = Window.partitionBy(pool).orderBy(claim, item)
    ranked = claims.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(pool))).withColumn("served", F.coalesce(F.sum(claim).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    level = (F.lit(budget) - F.col("served")) / (F.col("n") - F.col("k") + 1)
    # once a claim exceeds the level, it and all after it get the level of the first that did
    first = F.min(F.when(F.col(claim) > level, F.struct("k", level.alias("level")))).over(Window.partitionBy(pool))
    return ranked.withColumn("cut", first).select(pool, item, claim, F.round(F.when(F.col("cut").isNull() | (F.col("k") < F.col("cut.k")), F.col(claim)).otherwise(F.col("cut.level")), 4).alias("share"))
