"""Operators on timed values: as-of, windows, fill, edges and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(changes: DataFrame, times: DataFrame, signal: str, time: str, seq: str, value: str, default=None) -> DataFrame:
    """(signal, time, value): each signal's last value at or before each of ``times`` (one column, as ``time``).

    Of several changes at one time the one with the highest ``seq`` counts. Signals without a value yet are left out,
    or have ``default``. Changes and questions are sorted together once a signal, so the cost is that of a sort.
    """
    asked = changes.select(signal).distinct().crossJoin(F.broadcast(times.distinct())).select(F.col(signal), F.col(time), F.lit(None).cast(changes.schema[value].dataType).alias(value), F.lit(None).cast("bigint").alias(seq), F.lit(1).alias("asked"))
    both = changes.select(signal, time, value, F.col(seq).cast("bigint").alias(seq), F.lit(0).alias("asked")).unionByName(asked)
    w = Window.partitionBy(signal).orderBy(time, "asked", seq).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("last", F.last_value(F.when(F.col("asked") == 0, F.struct(F.col(value).alias("v"))), True).over(w)).where("asked = 1")
    out = filled.select(signal, time, F.col("last.v").alias(value))
    return out.where(F.col(value).isNotNull()) if default is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def forward_fill(df: DataFrame, value: str, order: list, by: list) -> DataFrame:
    """``value`` filled with the last one that isn't null, in order, within each group."""
    return df.withColumn(value, F.last_value(value, True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def edges(df: DataFrame, value: str, order: list, by: list) -> DataFrame:
    """The rows whose value differs from the one before, with it as ``previous``."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(*by).orderBy(*order))).where(~F.col(value).eqNullSafe(F.col("previous")))


def islands(df: DataFrame, key: str, order: list, by: list) -> DataFrame:
    """``df`` with ``island``: the number of its run of equal adjacent keys, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("start", starts).withColumn("island", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("start")


def between(df: DataFrame, time: str, first, last) -> DataFrame:
    """The rows from ``first`` to ``last``, both included."""
    return df.where(F.col(time).between(first, last))


def rolling_sum(df: DataFrame, value: str, time: str, length: int, by: list, name: str = "rolling") -> DataFrame:
    """``df`` with the sum of the values of each group at most ``length`` before a row's time, a whole number, up to it; rows of one time count for each other."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(time).rangeBetween(-length, 0)))


def first_seen(df: DataFrame, key: list, order: list) -> DataFrame:
    """One row of each key, the first in order; unlike dropDuplicates it says which."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
