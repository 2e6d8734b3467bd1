"""Graphs of many modules at once: levels, components and reach inside each module.

Nodes are (module, node), edges (module, src, dst). Edges that end at what isn't among their module's nodes, and rows
without a module or a name, are left out. A module is the work of one function call on its own rows, so a table of modules
takes one shuffle instead of a few jobs for each step of the longest path. A task gets its modules one after the other
out of one stream: many small groups cost a Python call each, not an Arrow stream. Modules of over ``LARGE`` rows aren't put into one
task: they all go through the rounds of ``graphs`` together, the module in front of each name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs
from .graphs import apart, cut

#: Nodes and edges of a module that one task takes; for ``reachable``, starts times edges.
LARGE, MOST_STEPS = 200_000, 2_000_000
#: Rows of results that a task hands over at once, or those of one module.
PIECE = 50_000


def _split(sizes: DataFrame, tables: list[DataFrame]) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """``tables`` without and with the modules of ``sizes`` (module); None where there are none."""
    tables = [t.where("module IS NOT NULL") for t in tables]
    sizes = cut(sizes)
    if sizes.isEmpty():
        return tables, None
    return [t.join(F.broadcast(sizes), "module", "left_anti") for t in tables], [t.join(F.broadcast(sizes), "module", "left_semi") for t in tables]


def _large(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    rows = nodes.select("module").unionAll(edges.select("module"))
    return rows.groupBy("module").agg(F.count("*").alias("n")).where(F.col("n") > most).select("module")


def _named(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.struct("module", F.col(c).alias("node")).alias(c) for c in columns])


def by_module(rows: DataFrame, find: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``find`` on the rows of each module (without it), in no order; ``schema`` is that of its rows behind the module. ``rows`` have no nulls."""
    columns, module = [c for c in rows.columns if c != "module"], rows.schema["module"].dataType.simpleString()
    names = ["module", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, mine, found = None, [], []
        for batch in batches:
            for m, *row in zip(batch["module"].tolist(), *[batch[c].tolist() for c in columns]):
                if m != key and mine:
                    found += [(key, *r) for r in find(mine)]
                    mine = []
                    if len(found) >= PIECE:
                        yield pd.DataFrame(found, columns=names)
                        found = []
                key = m
                mine.append(row)
        if mine:
            found += [(key, *r) for r in find(mine)]
        if found:
            yield pd.DataFrame(found, columns=names)

    return rows.repartition(graphs.tasks(rows.sparkSession), "module").sortWithinPartitions("module").mapInPandas(run, f"module {module}, {schema}")


def _tagged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, edge, src, dst): nodes lead to themselves."""
    one = nodes.select("module", F.lit(False).alias("edge"), F.col("node").alias("src"), F.col("node").alias("dst"))
    return one.unionAll(edges.select("module", F.lit(True).alias("edge"), "src", "dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def _each(nodes: DataFrame, edges: DataFrame, find: Callable[[list, dict], list[tuple]], add: str) -> DataFrame:
    """``find`` on each module's sorted nodes and the successors of each, other than itself; its rows with the module in front."""

    def run(rows: list[tuple]) -> list[tuple]:
        names = sorted({a for edge, a, _ in rows if not edge})
        after = {n: set() for n in names}
        for edge, a, b in rows:
            if edge and a in after and b in after and a != b:
                after[a].add(b)
        return find(names, after)

    kind = dict(nodes.dtypes)["node"]
    return by_module(_tagged(nodes, edges), run, f"node {kind}, {add.format(node=kind)}")


def _strong(names: list, after: dict) -> dict:
    """The greatest node of each node's component: one walk along the edges, one against them from what was left last."""
    before = {n: [] for n in names}
    for a in names:
        for b in after[a]:
            before[b].append(a)
    left, seen = [], set()
    for start in names:
        if start in seen:
            continue
        seen.add(start)
        walk = [(start, iter(after[start]))]
        while walk:
            at, ahead = walk[-1]
            onward = next((b for b in ahead if b not in seen), None)
            if onward is None:
                left.append(at)
                walk.pop()
            else:
                seen.add(onward)
                walk.append((onward, iter(after[onward])))
    of: dict = {}
    for start in reversed(left):
        if start in of:
            continue
        of[start] = start
        members = [start]
        for at in members:  # grows while it is walked
            for b in before[at]:
                if b not in of:
                    of[b] = start
                    members.append(b)
        of.update(dict.fromkeys(members, max(members)))
    return of


def _kahn(after: dict) -> dict:
    """The longest path to each node that no cycle leads to."""
    waits, level = Counter(b for ahead in after.values() for b in ahead), dict.fromkeys(after, 0)
    ready = [n for n in after if not waits[n]]
    for n in ready:  # grows while it is walked
        for b in after[n]:
            level[b] = max(level[b], level[n] + 1)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return {n: level[n] for n in ready}


def components(nodes: DataFrame, edges: DataFrame, most: int = LARGE) -> DataFrame:
    """(module, node, component): the strong components of each module, named by their greatest node."""
    small, large = _split(_large(nodes, edges, most), [nodes, edges])
    found = _each(*small, lambda names, after: list(_strong(names, after).items()), "component {node}")
    if large is None:
        return found
    rest = graphs.strong_components(_inside(*large), _named(large[0], "node"))
    return found.unionByName(rest.select("node.module", F.col("node.node").alias("node"), F.col("component.node").alias("component")))


def layers(nodes: DataFrame, edges: DataFrame, most: int = LARGE) -> DataFrame:
    """(module, node, level): the longest path from a node without predecessors; nodes that reach each other share a level."""

    def find(names, after):
        of = _strong(names, after)
        ahead = {c: set() for c in of.values()}
        for a in names:
            ahead[of[a]].update(of[b] for b in after[a] if of[b] != of[a])
        level = _kahn(ahead)
        return [(n, level[of[n]]) for n in names]

    small, large = _split(_large(nodes, edges, most), [nodes, edges])
    found = _each(*small, find, "level int")
    if large is None:
        return found
    rest = graphs.layers(_inside(*large), _named(large[0], "node"))
    return found.unionByName(rest.select("node.module", F.col("node.node").alias("node"), "level"))


def partial_levels(nodes: DataFrame, edges: DataFrame, most: int = LARGE) -> DataFrame:
    """(module, node, level, resolved): as in ``graphs.partial_levels``, inside each module."""

    def find(names, after):
        level = _kahn(after)
        above: dict = {}
        for a in level:
            for b in after[a]:
                above[b] = max(above.get(b, 0), level[a] + 1)
        return [(n, level.get(n, above.get(n, 0)), n in level) for n in names]

    small, large = _split(_large(nodes, edges, most), [nodes, edges])
    found = _each(*small, find, "level int, resolved boolean")
    if large is None:
        return found
    rest = graphs.partial_levels(_inside(*large), _named(large[0], "node"))
    return found.unionByName(rest.select("node.module", F.col("node.node").alias("node"), "level", "resolved"))


def settled_levels(nodes: DataFrame, edges: DataFrame, most: int = LARGE) -> DataFrame:
    """(module, node, level): ``partial_levels``, where nodes that aren't resolved then go in the order of their names, each one more than the highest of its predecessors as these stand by then."""

    def find(names, after):
        level = _kahn(after)
        stuck = [n for n in names if n not in level]
        before = {n: [] for n in stuck}
        for a in names:
            for b in after[a]:
                if b in before:
                    before[b].append(a)
        level |= {n: max((level[a] + 1 for a in before[n] if a in level), default=0) for n in stuck}
        for n in stuck:
            level[n] = max(level[n], max(level[a] + 1 for a in before[n]))
        return [(n, level[n]) for n in names]

    small, large = _split(_large(nodes, edges, most), [nodes, edges])
    found = _each(*small, find, "level int")
    if large is None:
        return found
    rest = graphs.settled_levels(_inside(*large), _named(large[0], "node"))
    return found.unionByName(rest.select("node.module", F.col("node.node").alias("node"), "level"))


def reachable(edges: DataFrame, starts: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """(module, start, node, depth): what each of ``starts`` (module, node) reaches in its module, with the least number of steps; itself at 0."""

    def run(rows: list[tuple]) -> list[tuple]:
        after: dict = {}
        for edge, a, b in rows:
            if edge:
                after.setdefault(a, set()).add(b)
        found = []
        for start in {a for edge, a, _ in rows if not edge}:
            depth, known = {start: 0}, [start]
            for at in known:  # grows while it is walked
                for b in after.get(at, ()):
                    if b not in depth:
                        depth[b] = depth[at] + 1
                        known.append(b)
            found += [(start, n, k) for n, k in depth.items()]
        return found

    starts = starts.select("module", "node").distinct()
    count = lambda df, name: df.groupBy("module").agg(F.count("*").alias(name))
    sizes = count(starts, "s").join(apart(count(edges, "e")), "module").where(F.col("s") * F.col("e") > most).select("module")
    small, large = _split(sizes, [starts, edges.select("module", "src", "dst")])
    kind = dict(starts.dtypes)["node"]
    found = by_module(_tagged(*small), run, f"start {kind}, node {kind}, depth int")
    if large is None:
        return found
    rest = graphs.reachable(cut(_named(large[1], "src", "dst")), _named(large[0], "node"))
    return found.unionByName(rest.select("node.module", F.col("start.node").alias("start"), F.col("node.node").alias("node"), "depth"))


def _inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` between two of ``nodes``, by their full names."""
    known = lambda c: _named(nodes, "node").select(F.col("node").alias(c)).distinct()
    return cut(_named(edges, "src", "dst").join(apart(known("src")), "src", "left_semi").join(apart(known("dst")), "dst", "left_semi"))
