"""Streams of timed events, and catalogs kept up to date from a folder of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """The rows of a folder, or of files and folders that match a pattern, as a stream; later Parquet files are taken up as they come.

    Spark streams no single file by its plain name; a pattern that matches it does.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def stamped(events: DataFrame, time: str) -> DataFrame:
    """``time`` as a timestamp, which watermarks need."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, time: str, key: str, value: str, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, n, total) of each window and key; rows later than ``late`` behind the newest are dropped in a stream."""
    rows = stamped(events, time).withWatermark(time, late)
    return rows.groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def rolling(events: DataFrame, time: str, value: str, length: str = "60 seconds", step: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """(end, total): sums over the ``length`` before each ``step``, for budgets over a rolling time."""
    rows = stamped(events, time).withWatermark(time, late)
    return rows.groupBy(F.window(time, length, step).alias("w")).agg(F.sum(value).alias("total")).select(F.col("w.end").alias("end"), "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, start, end, n) of runs of events of a key less than ``gap`` apart."""
    rows = stamped(events, time).withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of(events: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events without repeats of ``keys``; the state holds keys for ``late``."""
    return stamped(events, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def since(events: DataFrame, seq: str, after: int) -> DataFrame:
    """The events behind a reader's position."""
    return events.where(F.col(seq) > after)


def drain(result: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into Parquet files under ``path``, and returns these.

    Reruns go on where the last one stopped: progress and state are kept under ``path`` too.
    """
    query = result.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/rows")


def drain_whole(result: DataFrame, path: str) -> DataFrame:
    """Runs an aggregation over what is there now, and returns the groups of all of it, those that no watermark has closed too.

    The groups are written after each batch under ``path``/rows/batch=n, and those of the last batch hold. A batch that
    is run again replaces its own folder; later runs go on with the state, and no row is too late for them.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    result.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = result.sparkSession.read.schema(T.StructType([*result.schema, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def upserted(source: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame]) -> None:
    """Runs ``extract`` on each batch of files and writes its rows under ``path``/batch=n.

    A batch that is run again after a failure replaces its own folder. ``latest`` reads the newest rows of each file.
    """

    def write(batch: DataFrame, n: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``upserted`` wrote, of each file (``path``) those of its last batch."""
    rows = spark.read.parquet(f"{path}/rows")
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["path", "batch"], "left_semi")
