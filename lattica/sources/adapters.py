"""Layers of a graph out of business tables: vertices, graded edges, sections, key accesses, paths.

Every layer has the columns that the operators expect; nothing here moves more than the columns it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Evidence grades by strength, and sources by preference at equal strength.
GRADES = {"exact": 2, "resolved": 1, "fuzzy": 0}
SOURCES = ("direct", "member", "binding")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rowid, name, definition, kind, file, is_def, lines): parts; names repeat, definitions are qualified by brand."""
    p = table(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return p.select(
        F.col("p_partkey").alias("rowid"),
        name.alias("name"),
        F.concat_ws("", "p_type", F.lit(" "), "p_brand", F.lit("::"), name).alias("definition"),
        F.when(F.col("p_size") <= 40, "function").when(F.col("p_size") <= 45, "variable").otherwise("macro").alias("kind"),
        F.col("p_brand").alias("file"),
        (F.col("p_size") % 2 == 0).alias("is_def"),
        F.col("p_size").cast("long").alias("lines"),
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, source, grade, seq): each order line points at the next one of its order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return line.withColumn("dst", F.lead("l_partkey").over(order)).where("dst is not null").select(
        F.col("l_partkey").alias("src"),
        "dst",
        F.when(F.col("l_returnflag") == "A", "direct").when(F.col("l_returnflag") == "N", "member").otherwise("binding").alias("source"),
        F.when(F.col("l_quantity") < 10, "fuzzy").when(F.col("l_linestatus") == "O", "resolved").otherwise("exact").alias("grade"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        F.col("l_quantity").alias("weight"),
    )


def key_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(participant, key_name, role, mode): users write (purchase, signup) and read (view, click) keys named by k and week."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    key = F.concat_ws("/", F.get_json_object("props", "$.k"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string"))
    role = F.when(F.col("event_type").isin("purchase", "signup"), "write").otherwise("read")
    return e.select(F.col("user_id").alias("participant"), key.alias("key_name"), role.alias("role"), F.when(F.col("event_type") == "purchase", "queued").when(F.col("event_type") == "signup", "inline").otherwise("unknown").alias("mode"), "event_id")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, holder, lo, hi): a user's error opens a section that their next signup ends; null where none does."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    later = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(1, Window.unboundedFollowing)
    ends = e.withColumn("hi", F.min(F.when(F.col("event_type") == "signup", F.col("at"))).over(later))
    return ends.where("event_type = 'error'").select(F.col("event_id").alias("section"), F.col("user_id").alias("holder"), F.col("at").alias("lo"), "hi")


def points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(point, holder, at): events of one type."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.col("event_id").alias("point"), F.col("user_id").alias("holder"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, symbol, external, unresolved): customers filed under region, nation and segment."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path"),
        F.col("c_custkey").alias("symbol"),
        (F.col("c_acctbal") < 0).alias("external"),
        (F.col("c_acctbal") > 9000).alias("unresolved"),
    )
