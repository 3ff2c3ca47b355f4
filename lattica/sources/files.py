"""Scans of file trees, prose files and code indexes through Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.text import matches_glob


def file_tree(spark: SparkSession, root: str, excluded: tuple[str, ...] = (), glob: str | None = None) -> DataFrame:
    """(path, size, modified, sha256): files below a root, paths relative to it, without those below excluded folders.

    Content is read only for the digest.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = reader.load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted("/" + root.split(":", 1)[-1].strip("/")) + "/", "")
    rows = found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    for folder in excluded:
        rows = rows.where(~((F.col("path") == folder) | F.startswith("path", F.lit(folder.rstrip("/") + "/"))))
    return rows.where(matches_glob(F.col("path"), glob)) if glob else rows


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def owning_root(files: DataFrame, roots: list[str]) -> DataFrame:
    """``files`` with ``root``: the first of a short list of roots that is the path or a folder above it."""
    root = F.lit(None).cast("string")
    for r in reversed(roots):
        root = F.when((F.col("path") == r) | F.startswith("path", F.lit(r.rstrip("/") + "/")), F.lit(r)).otherwise(root)
    return files.withColumn("root", root)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): lines of text files, numbered from 1; one file is one row until its lines are exploded."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n"))
    return whole.select("path", lines.alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def markdown_sections(lines: DataFrame) -> DataFrame:
    """(path, heading, first_line, last_line, body): sections of markdown files by heading, fenced code left alone."""
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fences = F.sum(F.rlike("line", F.lit(r"^\s*(```|~~~)")).cast("int")).over(order)
    head = F.rlike("line", F.lit(r"^#{1,6}\s+\S")) & (F.col("fences") % 2 == 0)
    marked = lines.withColumn("fences", fences).withColumn("head", head).withColumn("n", F.sum(F.col("head").cast("int")).over(order))
    own = F.struct("line_no", "line", "head")
    grouped = marked.groupBy("path", "n").agg(F.array_sort(F.collect_list(own)).alias("ls"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    heading = F.when(F.get("ls", F.lit(0))["head"], F.trim(F.regexp_replace(F.get("ls", F.lit(0))["line"], r"^#+|\s#+\s*$", ""))).otherwise("")
    body = F.array_join(F.transform(F.filter("ls", lambda x: ~x["head"]), lambda x: x["line"]), "\n")
    return grouped.select("path", heading.alias("heading"), "first_line", "last_line", F.trim(body).alias("body")).where("heading <> '' or body <> ''")


def json_index(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """(key, value.*): entries of an object-valued field of JSON files, whose schema is given, not inferred."""
    whole = spark.read.schema(f"{field} map<string, struct<{schema}>>").json(path, multiLine=True)
    return whole.select(F.explode(field).alias("key", "value")).select("key", "value.*")
