"""Value change dumps as tables: declarations of signals and their timed changes.

A dump is read in the blocks that Spark cuts files into. A change's time is that of the last time line before it, found
within its block; blocks whose first changes come before any time line take it from the blocks before, of which there is
one row each. So no task sorts a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIGNALS = "file string, id string, name string, scope string, full_name string, kind string, width int, ord int"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, line), trimmed; seq grows in a file's order.

    A block of n bytes has at most n lines, so its offset plus a line's number in it is an order over the file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.trim("value").alias("line")
    )
    first = F.min("row").over(Window.partitionBy("file", "block"))
    return raw.select("file", "block", (F.col("block") + F.col("row") - first + F.when(F.col("block") > 0, 1).otherwise(0)).alias("seq"), "line")


def _header_end(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("line").startswith("$enddefinitions")).groupBy("file").agg(F.min("seq").alias("header_end"))


def _walk(frame):
    """Declarations of one file's scope and variable lines: a stack of scopes."""
    import pandas as pd

    stack, seen, out = [], set(), []
    for file, line in frame.sort_values("seq")[["file", "line"]].itertuples(index=False):
        word = line.split()
        if word[0] == "$scope" and len(word) > 2:
            stack.append(word[2])
        elif word[0] == "$upscope":
            del stack[-1:]
        elif word[0] == "$var" and len(word) > 4 and word[3] not in seen:
            seen.add(word[3])
            name, scope = " ".join(w for w in word[4:] if w != "$end"), ".".join(stack)
            out.append((file, word[3], name, scope, f"{scope}.{name}" if scope else name, word[1], int(word[2]) if word[2].isdecimal() else 1, len(out)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SIGNALS.split(", ")])


def signals(rows: DataFrame, max_signals: int | None = 4000) -> DataFrame:
    """Declared signals of each file of ``lines``; the first declaration of an id counts, and ``max_signals`` of a file.

    Only scope and variable lines reach the grouped function, so a group is as large as a file's header.
    """
    header = rows.where(F.col("line").rlike(r"^\$(scope|upscope|var)\b")).join(_header_end(rows), "file", "left")
    found = header.where("header_end IS NULL OR seq < header_end").select("file", "seq", "line").groupBy("file").applyInPandas(_walk, SIGNALS)
    return found if max_signals is None else found.where(F.col("ord") < max_signals)


def timed(rows: DataFrame) -> DataFrame:
    """``lines`` with the time at each, 0 before any time line."""
    marked = rows.withColumn("mark", F.nullif(F.regexp_extract("line", r"^#(\d+)", 1), F.lit("")).try_cast("bigint"))
    within = marked.withColumn("here", F.last_value("mark", True).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy("file", "block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("seq"))).alias("last"))
    before = ends.withColumn("before", F.last_value("last", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    return within.join(before, ["file", "block"]).withColumn("time", F.coalesce("here", "before", F.lit(0))).drop("here", "before", "mark")


def changes(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """(file, id, full_name, time, seq, value): what each declared signal changes to, values as text without a prefix.

    Lines before the end of the header, those that start with ``$``, and ids that aren't declared are left out.
    """
    body = timed(rows.join(_header_end(rows), "file", "left").where("header_end IS NULL OR seq > header_end").drop("header_end"))
    vector, scalar = r"^[bBrR](\S+)\s+(\S+)", r"^([^#$bBrR\s])\s*(\S+)$"
    pick = lambda k: F.when(F.col("line").rlike(vector), F.regexp_extract("line", vector, k)).when(F.col("line").rlike(scalar), F.regexp_extract("line", scalar, k))
    found = body.select("file", pick(2).alias("id"), "time", "seq", pick(1).alias("value")).where("id IS NOT NULL")
    return found.join(declared.select("file", "id", "full_name"), ["file", "id"]).select("file", "id", "full_name", "time", "seq", "value")


def end_times(rows: DataFrame) -> DataFrame:
    """(file, end_time): the greatest time line of each file, whether or not anything changes there."""
    body = rows.join(_header_end(rows), "file", "left").where("header_end IS NULL OR seq > header_end")
    return body.groupBy("file").agg(F.max(F.regexp_extract("line", r"^#(\d+)", 1).try_cast("bigint")).alias("end_time"))
