"""Versions of files, catalogs kept up to date, and guarded saves, on the driver's tables, each beside the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design, runlogs, versions
from .bridge import _t

_Q: dict = {}


def _query(sql: str):
    def keep(f):
        _Q[f.__name__] = (f, sql)
        return f

    return keep


def _commits(s, d):
    """Documents as files at commit one; at two every fifth is gone, every fifth has changed, and some have a copy under another name."""
    k, path = F.col("doc_id") % 5, F.concat(F.lit("rtl/d"), F.col("doc_id").cast("string"), F.lit(".v"))
    docs = _t(s, d, "documents")
    one = docs.select(F.lit("one").alias("commit"), path.alias("path"), "text")
    two = docs.where(k != 0).select(F.lit("two").alias("commit"), path.alias("path"), F.when(k == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("\n// more"))).otherwise(F.col("text")).alias("text"))
    copies = docs.where(k == 2).select(F.lit("two").alias("commit"), F.concat(F.lit("copy/"), path).alias("path"), "text")
    bad = docs.where(k == 3).select(F.lit("two").alias("commit"), F.concat(F.lit("../"), path).alias("path"), "text")
    return versions.stored(one.unionByName(two).unionByName(copies).unionByName(bad))


_DOCS = "d AS (SELECT doc_id, 'rtl/d' || doc_id || '.v' AS path, coalesce(text, '') AS text FROM documents)"


@_query(f"WITH {_DOCS} SELECT path, sha256(CASE WHEN doc_id % 5 = 1 THEN text || chr(10) || '// more' ELSE text END) AS content FROM d WHERE doc_id % 5 <> 0 UNION ALL SELECT 'copy/' || path, sha256(text) FROM d WHERE doc_id % 5 = 2")
def files_as_of(s, d):
    return versions.as_of(*_commits(s, d), "two").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("content"))


@_query(f"WITH {_DOCS} SELECT path, CASE doc_id % 5 WHEN 0 THEN 'deleted' ELSE 'modified' END AS change FROM d WHERE doc_id % 5 < 2 UNION ALL SELECT 'copy/' || path, 'added' FROM d WHERE doc_id % 5 = 2")
def files_changed(s, d):
    return versions.changed_files(_commits(s, d)[0], "one", "two")


def _saves(s, d):
    """Ten modules a file. On saving, files ending in 1 lose some of theirs, 2 gain one, 3 do both, 4 no longer parse, 5 are new, 6 stay; the others aren't saved."""
    k, f = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    rows = _t(s, d, "part").select(F.concat(F.lit("f"), f.cast("string")).alias("path"), F.concat(F.lit("m"), k.cast("string")).alias("module"), (f % 10).alias("kind"), (k % 10).alias("place"))
    old = rows.where("kind <> 5").select("path", "module", F.lit("old").alias("version"))
    kept = rows.where("kind IN (2, 5, 6) OR (kind IN (1, 3) AND place > 2)")
    new = kept.select("path", "module").union(rows.where("kind IN (2, 3)").select("path", F.concat("path", F.lit("_added"))).distinct()).withColumn("version", F.lit("new"))
    return old, new, rows.where("kind BETWEEN 1 AND 6").select("path")


_PARTS = "p AS (SELECT 'f' || (p_partkey // 10) AS path, 'm' || p_partkey AS module, (p_partkey // 10) % 10 AS kind, p_partkey % 10 AS place FROM part)"


@_query(f"WITH {_PARTS} SELECT path, module, CASE WHEN kind IN (2, 5, 6) THEN 'new' ELSE 'old' END AS version FROM p UNION ALL SELECT DISTINCT path, path || '_added', 'new' FROM p WHERE kind = 2")
def guarded_saves(s, d):
    old, new, saved = _saves(s, d)
    return versions.merged(old, new, versions.save_decisions(old, new, saved))


@_query(f"WITH {_PARTS} SELECT path, module, CASE WHEN kind BETWEEN 1 AND 6 THEN 'new' ELSE 'old' END AS version FROM p WHERE kind <> 4 AND NOT (kind IN (1, 3) AND place <= 2) UNION ALL SELECT DISTINCT path, path || '_added', 'new' FROM p WHERE kind IN (2, 3)")
def file_saves(s, d):
    old, new, saved = _saves(s, d)
    return versions.merged(old, new, versions.save_decisions(old, new, saved, "file"))


@_query(f"""WITH {_PARTS} SELECT path, CASE kind WHEN 2 THEN 'reloaded' WHEN 5 THEN 'reloaded' WHEN 6 THEN 'replaced' ELSE CASE WHEN lost > 0 THEN 'kept' WHEN kind = 3 THEN 'reloaded' ELSE 'replaced' END END AS action, lost
FROM (SELECT path, kind, count(*) FILTER (WHERE kind = 4 OR (kind IN (1, 3) AND place <= 2)) AS lost FROM p WHERE kind BETWEEN 1 AND 6 GROUP BY path, kind) q""")
def save_decisions(s, d):
    return versions.save_decisions(*_saves(s, d)).select("path", "action", F.size("lost").cast("long").alias("lost"))


@_query(f"WITH {_PARTS} SELECT path, module, CASE WHEN kind IN (2, 5, 6) OR (kind IN (1, 3) AND place > 2) THEN 'new' ELSE 'old' END AS version FROM p WHERE NOT (kind IN (1, 3) AND place <= 2) UNION ALL SELECT DISTINCT path, path || '_added', 'new' FROM p WHERE kind IN (2, 3)")
def refreshed_rows(s, d):
    """A catalog after its files were read again; a file that no longer parses keeps its rows."""
    old, new, _ = _saves(s, d)
    return design.refreshed(old, new)


@_query("SELECT 'f' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0")
def stale_files(s, d):
    """Files to extract again: new ones, and those whose size or time has changed since."""
    k = F.col("o_orderkey")
    files = _t(s, d, "orders").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), (k * 10).alias("size"), F.col("o_orderdate").alias("modified"), k.alias("k"))
    known = files.where("k % 3 = 0").withColumn("size", F.when(F.col("k") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return design.stale(files.drop("k"), known.drop("k")).select("path")


@_query("SELECT 'b' || p_partkey AS bench, 'b' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.expected.txt' ELSE '.golden.txt' END AS path FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def golden_file_choice(s, d):
    """The file with the expected output of each test bench: of two that fit, the one whose ending is tried first."""
    bench = F.concat(F.lit("b"), F.col("p_partkey").cast("string"))
    parts = _t(s, d, "part")
    files = parts.where("p_partkey % 2 = 0").select(F.concat(bench, F.lit(".expected.txt")).alias("path")).union(parts.where("p_partkey % 3 = 0").select(F.concat(bench, F.lit(".golden.txt"))))
    return runlogs.golden_files(files.union(parts.select(F.concat(bench, F.lit(".txt")))), parts.select(bench.alias("bench")))


def queries() -> dict:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items()}
