"""Project files as rows: places below a root, test benches, text search, and version control listings."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File names and contents that tell a test bench, and the endings that a search covers, in its order.
BENCH_NAME = r"(?i)(?:^|[_\-])(?:tb|testbench|test)(?:[_\-]|$)"
BENCH_MARKS = ["$dumpvars", "$dumpfile", "$finish", "$monitor"]
SEARCHED = [".v", ".sv", ".vh", ".svh"]
# Separators and fields of a commit listing.
RECORD, FIELD = "\x1e", "\x1f"
COMMIT_FIELDS = ["commit", "short_commit", "author_name", "author_email", "authored_at", "subject"]
COMMIT_FORMAT = "%H%x1f%h%x1f%an%x1f%ae%x1f%ad%x1f%s%x1e"


def below(spark: SparkSession, root: str, path: Column) -> Column:
    """The part of ``path`` under ``root``; both may or may not name a scheme and a host. Other paths stay whole."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getRawPath().rstrip("/")
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(bare.startswith(f"{base}/"), F.substr(bare, F.lit(len(base) + 2))).otherwise(bare)


def test_benches(files: DataFrame, relative: Column | str = "path") -> DataFrame:
    """(path, name, relative, source, size) of files (path, text) that look like test benches.

    ``managed`` are all directly in the folder testbenches, ``discovered`` those whose name or first 8192 characters
    tell it. ``relative`` is the path under the project's root. Null texts count as empty.
    """
    rel = F.col(relative) if isinstance(relative, str) else relative
    name, head = F.substring_index("path", "/", -1), F.substring(F.coalesce("text", F.lit("")), 1, 8192)
    marked = F.regexp_replace(name, r"\.[^.]*$", "").rlike(BENCH_NAME)
    for mark in BENCH_MARKS:
        marked = marked | F.contains(head, F.lit(mark))
    source = F.when(rel.rlike(r"^testbenches/[^/]+$"), "managed").when(~rel.startswith("testbenches/") & marked, "discovered")
    return files.select("path", name.alias("name"), rel.alias("relative"), source.alias("source"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).where("source IS NOT NULL")


def compile_sources(files: DataFrame, excluded: DataFrame, relative: Column | str = "path", apart: tuple[str, ...] = ("testbenches",)) -> DataFrame:
    """The files to compile: those that end in .v or .sv, whatever the case, not in hidden folders or hidden themselves, nor under the folders ``apart``, nor among ``excluded`` (path). ``relative`` is the path under the project's root."""
    rel = F.col(relative) if isinstance(relative, str) else relative
    parts = F.split(rel, "/")
    kept = files.where(rel.rlike(r"(?i)[^/]\.s?v$") & ~F.exists(parts, lambda x: x.startswith(".")))
    for folder in apart:
        kept = kept.where(~rel.startswith(f"{folder}/"))
    return kept.join(excluded.select("path"), "path", "left_anti")


def search(files: DataFrame, pattern: str, endings: list[str] = SEARCHED, limit: int | None = 40) -> DataFrame:
    """(path, line_no, line) of lines that match, by ending, path and line; the first ``limit``, or all in no order if None.

    A pattern that isn't a valid expression is searched for as it stands. Lines count from 1 and show 200 characters.
    """
    try:
        re.compile(pattern)
    except re.error:
        pattern = rf"\Q{pattern}\E"
    rank = F.lit(None).cast("int")
    for k, ending in reversed(list(enumerate(endings))):
        rank = F.when(F.col("path").endswith(ending), k).otherwise(rank)
    rows = files.withColumn("rank", rank).where("rank IS NOT NULL").select("path", "rank", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line"))
    found = rows.where(F.col("line").rlike(pattern)).select("rank", "path", (F.col("n") + 1).alias("line_no"), F.left(F.rtrim("line"), F.lit(200)).alias("line"))
    return (found if limit is None else found.orderBy("rank", "path", "line_no").limit(limit)).drop("rank")


def commits(listings: DataFrame, text: str = "text") -> DataFrame:
    """Commits of listings in COMMIT_FORMAT, with ``ord``, newest first as listed; other columns of ``listings`` stay."""
    other = [c for c in listings.columns if c != text and c not in COMMIT_FIELDS + ["ord"]]
    rows = listings.select(*other, F.posexplode(F.split(text, RECORD)).alias("ord", "record"))
    parts = F.split(F.btrim("record", F.lit(" \t\r\n")), FIELD, len(COMMIT_FIELDS))
    return rows.where(F.size(parts) == len(COMMIT_FIELDS)).select(*other, "ord", *[parts[k].alias(f) for k, f in enumerate(COMMIT_FIELDS)])


def changes(listings: DataFrame, text: str = "text") -> DataFrame:
    """(code, path) of short status listings, two characters and a path a line; other columns of ``listings`` stay."""
    other = [c for c in listings.columns if c not in {text, "code", "path"}]
    rows = listings.select(*other, F.explode(F.split(text, r"\r?\n")).alias("line")).where("line <> ''")
    return rows.select(*other, F.left("line", F.lit(2)).alias("code"), F.substring("line", 4, 2**31 - 1).alias("path"))


def _git(folder: str, *words: str) -> str:
    return subprocess.run(["git", "-C", folder, *words], check=True, capture_output=True, text=True, timeout=60).stdout


def history(spark: SparkSession, folder: str, most: int = 50) -> DataFrame:
    """The newest ``most`` commits of a local repository."""
    if most < 1:
        raise ValueError("at least one commit must be asked for")
    listing = _git(folder, "log", f"--max-count={most}", "--date=iso-strict", f"--pretty=format:{COMMIT_FORMAT}")
    return commits(spark.createDataFrame([(listing,)], "text string"))


def status(spark: SparkSession, folder: str) -> DataFrame:
    """What differs in a local repository's working folder; empty if nothing does."""
    return changes(spark.createDataFrame([(_git(folder, "status", "--porcelain"),)], "text string"))
