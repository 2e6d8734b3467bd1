"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when the query ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set (tests, local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or f"{tempfile.gettempdir()}/netloom-shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/netloom/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def until_exit(spark: SparkSession, path: str) -> None:
    """What has been written to ``path`` goes when the application ends, if it isn't dropped before."""
    files, at = _files(spark, path)
    files.deleteOnExit(at)


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    until_exit(spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made.__dict__["stored_at"] = path
    return made


def drop(*tables: DataFrame) -> None:
    """Removes tables made by `materialize` that nothing reads any more."""
    for t in tables:
        files, at = _files(t.sparkSession, t.__dict__["stored_at"])
        files.delete(at, True)
