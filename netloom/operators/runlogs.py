"""Verdicts of simulation runs from their logs, and comparison with expected output."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from netloom.functions.scalars import TIME_FORMS, event_time

from .graphs import apart, tasks

# The words of a verdict, and the endings of files with expected output in the order in which they are tried.
VERDICTS = [("pass", ["PASS", "PASSED"]), ("fail", ["FAIL", "FAILED", "FAILURE"]), ("error", ["ERROR"]), ("fatal", ["FATAL"])]
GOLDEN_ENDINGS = [".expected.txt", ".expected", ".golden.txt", ".golden"]
#: White space at the ends of lines, which comparisons leave out.
WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Lines of diffs that a task hands over at once.
PIECE = 20_000
_WORDS = "|".join(w for _, ws in VERDICTS for w in sorted(ws, key=len, reverse=True))
_TOKEN = rf"(?i)(?<![A-Za-z0-9_])({_WORDS})(?![A-Za-z0-9_])"


def log_lines(logs: DataFrame, run: str, text: str) -> DataFrame:
    """(run, line_no, line) of logs with Unix or Windows line ends, stripped; line_no from 0. Null texts have no lines."""
    split = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n")
    return logs.select(F.col(run).alias("run"), F.posexplode(split).alias("line_no", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r\n\f\x0b")))


def events(lines: DataFrame) -> DataFrame:
    """``lines`` that aren't empty or about the dump, with warning and assertion flags, and the kind, verdict, label, detail and time.

    The first verdict word of a line counts; its kind is pass, fail, error or fatal, and all but pass have the verdict
    fail. The detail is what follows the word, without times; the label is the detail up to a colon, and the word itself
    where nothing follows. An assertion counts if the line says that it failed.
    """
    word, line = F.upper(F.regexp_extract("line", _TOKEN, 1)), F.col("line")
    kind = F.lit(None).cast("string")
    for name, words in reversed(VERDICTS):
        kind = F.when(word.isin(words), name).otherwise(kind)
    tail = F.regexp_extract("line", rf"{_TOKEN}\s*[:-]*\s*(.*)$", 2)
    for form in TIME_FORMS:
        tail = F.regexp_replace(tail, form, "")
    tail = F.btrim(tail, F.lit(" \t:-"))
    label = F.btrim(F.substring_index(tail, ":", 1), F.lit(" \t"))
    kept = lines.where((line != "") & ~line.startswith("VCD info:"))
    return kept.select(
        "run", "line_no", "line", line.rlike(r"(?i)(^|[\s:])(WARNING|\$warning)\b").alias("warning"), line.rlike(r"(?i)\bassert(ion)?\b.*\b(fail|error|violat)").alias("assertion"),
        kind.alias("kind"), F.when(kind == "pass", "pass").when(kind.isNotNull(), "fail").alias("verdict"),
        F.when(word != "", F.left(F.when(label != "", label).otherwise(word), F.lit(160))).alias("label"), F.when(word != "", F.left(tail, F.lit(400))).alias("detail"), event_time(line).alias("time"),
    )


def verdicts(found: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, counts, verdict, reason) of each of ``runs`` (run, exit_code, golden: match, mismatch or null), with or without events.

    In this order: a non-zero exit, a mismatch, any failure, a pass or match; else unknown. ``runs`` may name the file
    with the expected output in golden_path.
    """
    n = lambda c, name: F.count_if(c).alias(name)
    v = F.col("kind")
    counts = found.groupBy("run").agg(n(v == "pass", "passes"), n(v == "fail", "fails"), n(v == "error", "errors"), n(v == "fatal", "fatals"), n(F.col("warning"), "warnings"), n(F.col("assertion"), "assertions"))
    rows = runs.join(counts, "run", "left").fillna(0, ["passes", "fails", "errors", "fatals", "warnings", "assertions"])
    failed = F.col("fails") + F.col("errors") + F.col("fatals") + F.col("assertions") > 0
    exited, golden = F.coalesce("exit_code", F.lit(0)) != 0, F.coalesce("golden", F.lit(""))
    file = F.coalesce(F.regexp_extract("golden_path", "[^/]*$", 0), F.lit("the expected output")) if "golden_path" in runs.columns else F.lit("the expected output")
    bits = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {words}"))) for c, words in (("fails", "FAIL marker(s)"), ("errors", "$error/ERROR line(s)"), ("fatals", "$fatal line(s)"), ("assertions", "assertion failure(s)"))]
    reason = (
        F.when(exited, F.concat(F.lit("Simulation exited with code "), F.col("exit_code").cast("string"), F.lit("."))).when(golden == "mismatch", F.concat(F.lit("Output differs from "), file, F.lit(".")))
        .when(failed, F.concat(F.lit("Run reported "), F.concat_ws(", ", *bits), F.lit("."))).when(golden == "match", F.concat(F.lit("Output matches "), file, F.lit(".")))
        .when(F.col("passes") > 0, F.concat(F.col("passes").cast("string"), F.lit(" PASS marker(s), no errors."))).otherwise("No PASS/FAIL markers and no golden file.")
    )
    verdict = F.when(exited | (golden == "mismatch") | failed, "fail").when((F.col("passes") > 0) | (golden == "match"), "pass").otherwise("unknown")
    return rows.withColumn("verdict", verdict).withColumn("reason", reason)


def run_status(runs: DataFrame) -> DataFrame:
    """``runs`` with status: of (has_tools, compile_timed_out, compile_exit, has_image, run_timed_out, run_exit), what went wrong first, else ok."""
    bad = lambda timed_out, code: F.coalesce(F.col(timed_out), F.lit(False)) | (F.coalesce(code, F.lit(0)) != 0)
    compiled = ~bad("compile_timed_out", "compile_exit") & F.coalesce("has_image", F.lit(False))
    return runs.withColumn("status", F.when(~F.coalesce("has_tools", F.lit(False)), "tool_missing").when(~compiled, "compile_error").when(bad("run_timed_out", "run_exit"), "runtime_error").otherwise("ok"))


def messages(lines: DataFrame, default: str = "error") -> DataFrame:
    """(run, line_no, severity, message, file, file_line) of a compiler's ``lines``: file:line: [severity:] text, notes as info; other lines are info without a place. Blank lines are left out."""
    pattern = r"(?i)^(.+?):(\d+):\s*(?:(error|warning|note)\s*:?\s*)?(.*)$"
    part = lambda k: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    severity = F.when(part(2).isNull() | (F.lower(part(3)) == "note"), "info").otherwise(F.coalesce(F.lower(part(3)), F.lit(default)))
    text = F.coalesce(F.nullif(F.btrim(part(4)), F.lit("")), "line")
    return lines.where(F.btrim("line") != "").select("run", "line_no", severity.alias("severity"), text.alias("message"), F.btrim(part(1)).alias("file"), part(2).try_cast("int").alias("file_line"))


def golden_files(files: DataFrame, benches: DataFrame) -> DataFrame:
    """(bench, path): for each bench (bench: path without its ending) the file with expected output whose ending is tried first."""
    rank = F.lit(None).cast("int")
    for k, ending in reversed(list(enumerate(GOLDEN_ENDINGS))):
        rank = F.when(F.col("path") == F.concat("bench", F.lit(ending)), k).otherwise(rank)
    keys = benches.select("bench", F.explode(F.array(*[F.concat("bench", F.lit(e)) for e in GOLDEN_ENDINGS])).alias("path"))
    n = tasks(files.sparkSession)
    return keys.repartition(n, "path").join(apart(files.select("path").repartition(n, "path").distinct()), "path").withColumn("rank", rank).groupBy("bench").agg(F.min_by("path", "rank").alias("path"))


def compared(actual: DataFrame, expected: DataFrame, run: str = "run", text: str = "text") -> DataFrame:
    """(run, line_no, actual, expected, same) of two tables of whole outputs, by position, over their `output_lines`."""
    lines = lambda df, name: df.select(F.col(run).alias("run"), F.posexplode(output_lines(F.col(text))).alias("line_no", name))
    both = lines(actual, "actual").join(lines(expected, "expected"), ["run", "line_no"], "full_outer")
    return both.withColumn("same", F.col("actual").eqNullSafe(F.col("expected")))


def output_lines(text: Column) -> Column:
    """The lines of an output as they are compared: without white space at their ends; a blank last line is dropped once. Null has none."""
    lines = F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.rtrim(x, F.lit(WHITE)))
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def golden_diffs(actual: DataFrame, expected: DataFrame, run: str = "run", text: str = "text", most: int | None = 200) -> DataFrame:
    """(run, matched, diff) for each run that has an expected output: whether both have the same `output_lines`, and the lines of their unified diff.

    A run without an actual output has printed nothing. Beyond ``most`` lines, one says how many more there are; None
    keeps all. An empty expected output is matched by an empty one only.
    """

    def unified(a: list[str], b: list[str]) -> list[str]:
        lines = list(difflib.unified_diff(a, b, fromfile="expected", tofile="actual", lineterm=""))
        return lines if most is None or len(lines) <= most else [*lines[:most], f"... ({len(lines) - most} more diff lines truncated)"]

    def diffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for of, wanted, got in zip(*batch.columns):
                found.append({"run": of.as_py(), "diff": unified(wanted.as_py(), got.as_py())})
                size += len(found[-1]["diff"]) + 1
                if size >= PIECE:
                    yield pa.RecordBatch.from_pylist(found, made)
                    found, size = [], 0
        if found:
            yield pa.RecordBatch.from_pylist(found, made)

    wanted = expected.select(F.col(run).alias("run"), output_lines(F.col(text)).alias("wanted"))
    both = wanted.join(actual.select(F.col(run).alias("run"), output_lines(F.col(text)).alias("got")), "run", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    matched = both.where(F.col("wanted") == F.col("got")).select("run", F.lit(True).alias("matched"), F.array().cast("array<string>").alias("diff"))
    rows = both.where(F.col("wanted") != F.col("got")).select("run", "wanted", "got")
    kind = StructType([rows.schema["run"], StructField("diff", ArrayType(StringType()))])
    made = to_arrow_schema(kind)
    return matched.unionByName(rows.mapInArrow(diffs, kind).withColumn("matched", F.lit(False)))
