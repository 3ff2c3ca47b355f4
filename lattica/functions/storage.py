"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of intermediate tables that this process has written and not removed.
_written: list[str] = []


def written() -> list[str]:
    """Paths of the intermediate tables there are, in the order of writing."""
    return list(_written)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove intermediate tables that no query will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _written:
            _written.remove(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a single-JVM session gets a temporary folder (its driver and executor are one process), which
    goes when Python ends; any other session falls back to its warehouse folder, if that is in a store that machines share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if "://" not in warehouse and not warehouse.startswith("hdfs:") or warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share; the warehouse is a local one")
        found = warehouse + "/lattica-scratch"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go when it ends, instead of when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str, compression: str = "zstd", owned: dict[str, str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    ``owned`` gets the path under ``name``, for an owner that discards the table once nothing reads it.
    Rows are filed by the columns ``by``, so that readers that ask for some of their values leave the other files alone.
    """
    path = scratch_path(df.sparkSession, name)
    _written.append(path)
    if owned is not None:
        owned[name] = path
    with _shuffles_removed(df.sparkSession):
        df.write.partitionBy(*by).option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
