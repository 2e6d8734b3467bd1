"""Command line: ``python -m netloom scan FOLDER [--out FOLDER] [--graph]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import design, graphs
from netloom.project import looks_like_bench
from netloom.sources import rtl


#: Tops and nodes of the tree that are printed; what is left out is said.
SHOWN_TOPS, SHOWN_NODES = 100, 1000


def more(n: int) -> str:
    return f" … and {n} more" if n > 0 else ""


def scan(spark: SparkSession, root: str, out: str | None = None, graph: bool = False) -> int:
    """Prints counts, tops and the tree under each top; writes the catalog's tables as JSON under ``out``. 2 if there is nothing or no single top for the graph."""
    files = rtl.scan(spark, root).cache()
    mods = rtl.modules(files).cache()
    try:
        return report(spark, files, mods, out, graph)
    finally:  # a later scan of the folder would meet the cached rows
        mods.unpersist()
        files.unpersist()


def report(spark: SparkSession, files: DataFrame, mods: DataFrame, out: str | None, graph: bool) -> int:
    tables = design.catalog(mods)
    n_files, n_modules = files.count(), mods.count()
    print(f"{n_files} files, {n_modules} modules, {rtl.diagnostics(files, mods).count()} diagnostics")
    if not n_modules:
        return 2
    names = tables["modules"].select(F.col("module").alias("name"), looks_like_bench(F.col("module"), F.col("path")).alias("is_testbench"))
    links = design.children(tables)
    tops = graphs.infer_tops(names, links.join(names.select(F.col("name").alias("parent"), F.col("is_testbench").alias("parent_is_testbench")), "parent"))
    n_tops = tops.count()
    found = [r["name"] for r in tops.orderBy("name").limit(SHOWN_TOPS).collect()]
    print("tops:", ", ".join(found) + more(n_tops - len(found)))
    tree = graphs.hierarchy(links, tops.select(F.col("name").alias("node"))).cache()
    shown = tree.orderBy("path").limit(SHOWN_NODES).collect()
    for r in shown:
        print("  " * r["depth"] + r["node"] + (" (cycle)" if r["cycle"] else ""))
    print(more(tree.count() - len(shown)), end="")
    if out:
        for name, table in tables.items():
            table.write.mode("overwrite").json(f"{out}/{name}")
    if graph:
        if n_tops != 1:
            print("a graph needs exactly one top", file=sys.stderr)
            return 2
        edges = design.connectivity(design.endpoints(tables)).where(F.col("module") == found[0])
        edges.write.mode("overwrite").json(f"{out}/graph") if out else edges.orderBy("net", "src", "dst").show(1000, False)
    return 0


def main(words: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="netloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verb = verbs.add_parser("scan", help="catalog the design files under a folder")
    verb.add_argument("root", nargs="?", default=".")
    verb.add_argument("--out")
    verb.add_argument("--graph", action="store_true")
    given = parser.parse_args(words)
    return scan(SparkSession.builder.getOrCreate(), given.root, given.out, given.graph)


if __name__ == "__main__":
    sys.exit(main())
