"""Edge algebra: first-writer dedup, two-hop composition, strongest evidence, pruning, dispatch, shared keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

#: Writer and reader pairs of a key beyond which it joins nothing.
KEY_PRODUCT = 64
#: Pairs through one middle node that one task makes; a node with more of them is dealt to several.
HUB_PAIRS = 1_000_000


def first_writer(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row for each key: the one written first. Rows with a null in the key never conflict and all stay."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    rest = [c for c in rows.columns if c not in key and c != seq]
    kept = rows.where(whole).groupBy(*key).agg(F.min(F.struct(F.col(seq), *rest)).alias("first"))
    kept = kept.select(*key, F.col(f"first.{seq}").alias(seq), *[F.col(f"first.{c}").alias(c) for c in rest])
    return kept.select(rows.columns).unionByName(rows.where(~whole))


def last_writer(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row for each key: the one written last."""
    rest = [c for c in rows.columns if c not in key and c != seq]
    kept = rows.groupBy(*key).agg(F.max(F.struct(F.col(seq), *rest)).alias("last"))
    return kept.select(*key, F.col(f"last.{seq}").alias(seq), *[F.col(f"last.{c}").alias(c) for c in rest])


def two_hop(edges: DataFrame, hub_pairs: int = HUB_PAIRS, onward: DataFrame | None = None) -> DataFrame:
    """(src, dst, via, n_paths): pairs two edges apart, no pair of a node with itself, with the smallest middle node.

    The second edge is one of ``onward``, if given. Edges into a hub are dealt over as many shares as its pairs ask for, and its edges out are copied to each share.
    """
    edges = materialize(edges.select("src", "dst"), "hops")
    onward = edges if onward is None else materialize(onward.select("src", "dst"), "hops-onward")
    into, out = edges.select("src", F.col("dst").alias("via")), onward.select(F.col("src").alias("via"), "dst")
    pairs = into.groupBy("via").agg(F.count("*").alias("n_in")).join(out.groupBy("via").agg(F.count("*").alias("n_out")), "via")
    hubs = pairs.where(F.col("n_in") * F.col("n_out") > hub_pairs).select("via", F.least("n_in", F.ceil(F.col("n_in") * F.col("n_out") / hub_pairs)).cast("int").alias("shares"))
    shares = F.coalesce("shares", F.lit(1))
    dealt = into.join(hubs, "via", "left").select("src", "via", F.pmod(F.xxhash64("src"), shares).cast("int").alias("share"))
    copied = out.join(hubs, "via", "left").select("via", "dst", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    both = dealt.join(copied, ["via", "share"]).where("src <> dst")
    return both.groupBy("src", "dst").agg(F.min("via").alias("via"), F.count("*").alias("n_paths"))


def place(column: Column, ordered: tuple[str, ...]) -> Column:
    """Position in a vocabulary, the last place for unknown values."""
    found = F.lit(len(ordered))
    for i, value in enumerate(ordered):
        found = F.when(column == value, i).otherwise(found)
    return found


def strongest(edges: DataFrame, keys: list[str], grades: dict[str, int], sources: tuple[str, ...]) -> DataFrame:
    """One row for each ``keys``: its best grade, of equal ones the preferred source, and the number of rows."""
    rank = F.coalesce(F.element_at(F.create_map(*[x for k, v in grades.items() for x in (F.lit(k), F.lit(v))]), F.col("grade")), F.lit(-1))
    best = F.max(F.struct(rank.alias("rank"), (-place(F.col("source"), sources)).alias("place"), "source", "grade")).alias("best")
    return edges.groupBy(*keys).agg(best, F.count("*").alias("n_rows")).select(*keys, F.col("best.source").alias("source"), F.col("best.grade").alias("grade"), "n_rows")


def without_evidence(edges: DataFrame) -> DataFrame:
    """(src, dst, n_rows): pairs all of whose rows are fuzzy or ungraded."""
    firm = F.sum(F.when(F.col("grade") != "fuzzy", 1).otherwise(0))
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n_rows"), firm.alias("firm")).where("firm = 0").drop("firm")


def dominated(edges: DataFrame, identity: DataFrame, overrides: DataFrame) -> DataFrame:
    """Fuzzy edges with a verdict: unanchored, same_identity, override or dominated.

    A fuzzy edge is anchored if its source has a firm edge to some node of the same name. It is kept where a firm target
    has its own identity, or where the two targets override each other; else it is dominated. ``identity``: (rowid, name,
    qualified); ``overrides``: (child, parent), both directions count.
    """
    named = edges.join(identity.select(F.col("rowid").alias("dst"), "name", "qualified"), "dst")
    named = materialize(named.select("src", "dst", "source", "grade", "name", "qualified"), "named-edges")
    fuzzy = named.where("grade = 'fuzzy'").select("src", "dst", "source", "name", "qualified").distinct()
    firm = named.where("grade <> 'fuzzy'").select("src", "name", F.col("dst").alias("anchor"), "qualified").distinct()
    # three tests for existence, so that many fuzzy and many firm edges of one source and name never meet in pairs
    anchored = firm.select("src", "name").distinct().withColumn("anchored", F.lit(True))
    alike = firm.select("src", "name", "qualified").distinct().withColumn("same", F.lit(True))
    pairs = overrides.select(F.col("child").alias("dst"), F.col("parent").alias("anchor")).unionByName(overrides.select(F.col("parent").alias("dst"), F.col("child").alias("anchor"))).distinct()
    over = fuzzy.join(pairs, "dst").join(firm.select("src", "name", "anchor"), ["src", "name", "anchor"], "left_semi").select("src", "name", "dst").distinct().withColumn("over", F.lit(True))
    joined = fuzzy.join(anchored, ["src", "name"], "left").join(alike, ["src", "name", "qualified"], "left").join(over, ["src", "name", "dst"], "left")
    grouped = joined.groupBy("src", "dst", "source").agg(*[F.max(c).alias(c) for c in ("anchored", "same", "over")])
    verdict = F.when(F.col("anchored").isNull(), "unanchored").when(F.col("same"), "same_identity").when(F.col("over"), "override").otherwise("dominated")
    return grouped.select("src", "dst", "source", verdict.alias("verdict"))


def shared_key_pairs(accesses: DataFrame, most: int = KEY_PRODUCT, suppressed: bool = False) -> DataFrame:
    """(key_name, writer, reader) of keys with at most ``most`` writer and reader pairs; else their counts.

    Counts are made before the join, so a key that all rows share never meets itself.
    """
    own = accesses.select("key_name", "role", "participant").distinct()
    counts = own.groupBy("key_name").agg(F.sum(F.when(F.col("role") == "write", 1).otherwise(0)).alias("writers"), F.sum(F.when(F.col("role") == "read", 1).otherwise(0)).alias("readers"))
    if suppressed:
        return counts.where(F.col("writers") * F.col("readers") > most)
    good = own.join(counts.where((F.col("writers") * F.col("readers")).between(1, most)).select("key_name"), "key_name")
    writers = good.where("role = 'write'").select("key_name", F.col("participant").alias("writer"))
    return writers.join(good.where("role = 'read'").select("key_name", F.col("participant").alias("reader")), "key_name")


def one_sided(accesses: DataFrame) -> DataFrame:
    """(key_name, side): keys that are only written, or only read."""
    sides = accesses.groupBy("key_name").agg(F.max((F.col("role") == "write").cast("int")).alias("w"), F.max((F.col("role") == "read").cast("int")).alias("r"))
    return sides.where("w <> r").select("key_name", F.when(F.col("w") == 1, "write").otherwise("read").alias("side"))


def first_known(rows: DataFrame, keys: list[str], value: str, seq: str, unknown: str = "unknown") -> DataFrame:
    """For each ``keys``, the first value that is not ``unknown``, or that where there is no other."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct((F.col(value) == unknown).alias("u"), seq)).alias(value))


def side_counts(rows: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """(key_name, role, participant, n_others): distinct participants of keys that have both ``sides``, and how many they meet.

    ``rows``: (key_name, role, participant). The pairs of a key are not listed, so the result is no larger than ``rows``.
    """
    own = rows.select("key_name", "role", "participant").distinct()
    one, other = sides
    counts = own.groupBy("key_name").agg(*[F.sum((F.col("role") == r).cast("long")).alias(r) for r in sides])
    met = F.when(F.col("role") == one, F.col(other)).otherwise(F.col(one)).alias("n_others")
    return own.join(counts, "key_name").select("key_name", "role", "participant", met).where("n_others > 0")
