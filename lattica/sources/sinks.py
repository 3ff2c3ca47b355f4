"""Sinks: staged table swaps, metadata upserts, JSON rows without absent fields, byte budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def swap_table(rows: DataFrame, path: str) -> None:
    """Write a new table beside ``path``, then rename it into place.

    No reader sees half a table, but between two renames there is none at ``path``; use ``publish_table`` where readers run
    meanwhile.
    """
    spark = rows.sparkSession
    import uuid

    staged, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(staged), at(path))
    if fs.exists(at(old)):
        fs.delete(at(old), True)


def publish_table(rows: DataFrame, path: str) -> str:
    """Write a new version below ``path`` and make it the current one; returns the version's path.

    The name of the current version is in one small file, which is replaced by one rename: readers of ``current_table`` see the
    old rows or the new ones, also after a crash at any point. Older versions stay for readers that have begun.
    """
    import uuid

    spark = rows.sparkSession
    name = f"version-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    staged = at(f"{path}/_next-{name}")
    out = staged.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(staged)
    out.write(bytearray(name.encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(staged, at(f"{path}/_current"), options)
    return f"{path}/{name}"


def current_version(spark: SparkSession, path: str) -> str | None:
    """The path of the current version, if any has been published."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    name = bytes(stream.readNBytes(200)).decode()
    stream.close()
    return f"{path}/{name}"


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that is current now."""
    found = current_version(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(found)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Add rows to the CSV files at ``path``, in the columns that the first ones had; others are refused."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        columns = spark.read.option("header", True).csv(path).columns
        if sorted(columns) != sorted(rows.columns):
            raise ValueError(f"metrics at {path} have the columns {columns}, not {rows.columns}")
        rows = rows.select(columns)
    rows.write.mode("append").option("header", True).csv(path)


def upsert(before: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``changes`` and those of ``before`` whose key is not among them."""
    return before.join(changes.select(*key), key, "left_anti").unionByName(changes)


def wire_json(row_columns: list[str]) -> Column:
    """One JSON object of the columns; empty strings and ``unknown`` are left out like nulls."""
    return F.to_json(F.struct(*[F.when(~F.col(c).cast("string").isin("", "unknown"), F.col(c)).alias(c) for c in row_columns]), {"ignoreNullFields": "true"})


def within_bytes(rows: DataFrame, group: str, order: list[str], body: str, budget: int) -> DataFrame:
    """Rows of each group, in order, while their JSON fits a budget; ``left_out`` counts the rest."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    sized = rows.withColumn("used", F.sum(F.octet_length(body)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("left_out", F.sum((F.col("used") > budget).cast("int")).over(Window.partitionBy(group)))
    return sized.where(F.col("used") <= budget).drop("used")
