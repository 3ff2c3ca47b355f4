"""Results of a stage kept by content: rows are reused where input, version and configuration are those they were made of."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def configuration(options: dict) -> str:
    """A name for a stage's options, whatever their order."""
    return hashlib.sha256(json.dumps(options, sort_keys=True).encode()).hexdigest()[:16]


def _check(columns: list[str], version: str, config: str) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(version), F.lit(config), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 256)


def cached_stage(inputs: DataFrame, key: str, digest: str, compute: Callable[[DataFrame], DataFrame], path: str, version: str, options: dict) -> DataFrame:
    """(key, what ``compute`` returns, reused): the stage's result for every row of ``inputs``, of which only new ones are computed.

    ``inputs`` has one row a ``key``, with the ``digest`` of what the result depends on; ``compute`` gives one row a key of the rows
    it is given, and the same one each time. The table at ``path`` is partitioned by version, configuration and run, so that other
    versions and options are never read. A stored row counts only if the digest over its columns fits: one that was changed is
    computed anew. Runs are appended whole or not at all, so a run that fails costs only itself; what two runs wrote alike counts
    once. Rows with a null key or digest are computed each time and reused by none; the result leaves out keys that ``compute`` leaves out.
    """
    spark, config, run = inputs.sparkSession, configuration(options), uuid.uuid4().hex
    made = compute(inputs.limit(0))
    values = [c for c in made.columns if c != key]
    columns = [key, digest, *values]
    schema = inputs.select(key, digest).limit(0).crossJoin(made.select(*values).limit(0)).selectExpr("*", "'' as check").schema
    for name in ("version", "config", "run"):
        schema = schema.add(name, "string")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        stored = spark.read.schema(schema).parquet(path).where((F.col("version") == version) & (F.col("config") == config))
        sound = stored.where(F.col("check") == _check(columns, version, config))
        sound = sound.groupBy(key, digest).agg(F.min_by(F.struct(*values), "check").alias("kept"))
        hits = inputs.select(key, digest).join(sound, [key, digest]).select(key, "kept.*").withColumn("reused", F.lit(True))
        missing = inputs.join(sound.select(key, digest), [key, digest], "left_anti").select(inputs.columns)
    else:
        hits, missing = None, inputs
    made = missing.select(key, digest).join(compute(missing), key) if digest not in made.columns else compute(missing)
    # null keys meet nothing in the join; they are computed rows of their own
    unnamed = compute(missing.where(F.col(key).isNull())).select(key, F.lit(None).cast(inputs.schema[digest].dataType).alias(digest), *values)
    rows = made.select(*columns).unionByName(unnamed).withColumn("check", _check(columns, version, config))
    rows = rows.select("*", F.lit(version).alias("version"), F.lit(config).alias("config"), F.lit(run).alias("run"))
    rows.write.mode("append").partitionBy("version", "config", "run").parquet(path)
    fresh = spark.read.schema(schema).parquet(path).where((F.col("version") == version) & (F.col("config") == config) & (F.col("run") == run)).select(key, *values).withColumn("reused", F.lit(False))
    return hits.unionByName(fresh) if hits is not None else fresh
