"""Versions of design files: contents by commit, each stored once, and saves that are guarded by what a file defines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blob_id(text: Column) -> Column:
    """The id that git gives a file's content."""
    body = F.coalesce(text, F.lit("")).cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(body).cast("string"), F.lit("\0")).cast("binary"), body))


def inside(path: Column) -> Column:
    """Whether a path stays under the folder that it is relative to."""
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:|\\") & ~F.exists(F.split(path, "/"), lambda p: p == "..")


def stored(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, blobs) of files (commit, path, text): which content each path has at each commit, and every content once.

    Paths that leave their folder are left out. A null text is an empty file.
    """
    rows = files.where(inside(F.col("path"))).select("commit", "path", blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("commit", "path", "blob"), rows.groupBy("blob").agg(F.any_value("text").alias("text"))


def as_of(tree: DataFrame, blobs: DataFrame, commit: str) -> DataFrame:
    """(path, text): the files at a commit."""
    return tree.where(F.col("commit") == commit).join(blobs, "blob").select("path", "text")


def changed_files(tree: DataFrame, before: str, after: str) -> DataFrame:
    """(path, change): files added, deleted and modified from one commit to another."""
    at = lambda commit, name: tree.where(F.col("commit") == commit).select("path", F.col("blob").alias(name))
    both = at(before, "a").join(at(after, "b"), "path", "full_outer").where("NOT a <=> b")
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("modified").alias("change"))


def save_decisions(old: DataFrame, new: DataFrame, saved: DataFrame, policy: str = "module") -> DataFrame:
    """(path, lost, added, action, warning) of the files of ``saved`` (path), by the modules (path, module) that they defined and define now.

    Files that define the same names as before are ``replaced``. Of the others, policy ``module`` keeps the old rows
    where names are lost (``kept``, with a warning) and reads anew where some are only added (``reloaded``); policy
    ``file`` reads anew in both cases. A file that doesn't parse any more has lost its names.
    """
    if policy not in ("module", "file"):
        raise ValueError(f"no such policy: {policy}")
    names = lambda df, c: df.groupBy("path").agg(F.array_sort(F.collect_set("module")).alias(c))
    none = F.array().cast("array<string>")
    rows = saved.select("path").distinct().join(names(old, "a"), "path", "left").join(names(new, "b"), "path", "left").select("path", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    rows = rows.select("path", F.array_except("a", "b").alias("lost"), F.array_except("b", "a").alias("added"), (F.size("a") == 0).alias("fresh"))
    lost, added = F.size("lost") > 0, F.size("added") > 0
    action = F.when(lost & F.lit(policy == "module"), "kept").when(lost | added | F.col("fresh"), "reloaded").otherwise("replaced")
    rows = rows.withColumn("action", action)
    return rows.select("path", "lost", "added", "action", F.when(F.col("action") == "kept", F.concat(F.lit("The file no longer defines "), F.array_join("lost", ", "), F.lit("; its rows were left as they are."))).alias("warning"))


def merged(old: DataFrame, new: DataFrame, decisions: DataFrame) -> DataFrame:
    """A catalog table after the saves: rows of ``new`` for files that were replaced or reloaded, of ``old`` for all others."""
    taken = decisions.where("action <> 'kept'").select("path")
    return old.join(taken, "path", "left_anti").unionByName(new.join(taken, "path", "left_semi"))
