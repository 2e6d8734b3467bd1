"""Crossings of routes, order within layers, and places of blocks."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .graphs import apart, cut, tasks
from .within import by_module

#: A cell in which pairs are counted has sides of so many bits; cells that are counted at once.
BITS, CELLS = 6, 16
#: Kinds of marks: where segments start and go on or end, segments without length, a block's left and upper edge and its inside.
START, GOES = {"level": 0, "upright": 1}, {"level": 2, "upright": 3}
DOT, EDGE, UPPER, INSIDE = 4, 5, 6, 7


def crossings(level: DataFrame, upright: DataFrame, cell: int = 64) -> DataFrame:
    """(h, v): level segments (h, y, x1, x2) and upright ones (v, x, y1, y2) that cross inside both, ends left out.

    A join on square cells of the plane: a level segment is in each cell that it spans, all of one row, an upright one in
    cells of one column, so a pair meets once.
    """
    spans = level.withColumns({"cell": _span("x1", "x2", cell), "row": F.floor(F.col("y") / cell)})
    columns = upright.withColumns({"cell": F.floor(F.col("x") / cell), "row": _span("y1", "y2", cell)})
    return spans.join(apart(columns), ["cell", "row"]).where("x1 < x AND x < x2 AND y1 < y AND y < y2").select("h", "v")


def _span(low: str, high: str, cell: int):
    """The numbers of the cells from ``low`` to ``high``, a row each."""
    return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))


def overlaps(level: DataFrame, upright: DataFrame, blocks: DataFrame, cell: int = 64) -> DataFrame:
    """(segment, block): segments, as in ``crossings``, that run through the inside of a block (block, x1, y1, x2, y2); by square cells, of which the first that a pair shares counts."""
    first = lambda c: F.floor(F.col(c) / cell)
    held = blocks.select("block", F.col("x1").alias("left"), F.col("y1").alias("top"), F.col("x2").alias("right"), F.col("y2").alias("bottom"))
    held = held.withColumn("cell", _span("left", "right", cell)).withColumn("row", _span("top", "bottom", cell))
    flat = level.withColumns({"cell": _span("x1", "x2", cell), "row": first("y")}).join(apart(held), ["cell", "row"])
    flat = flat.where((F.col("cell") == F.greatest(first("x1"), first("left"))) & F.expr("top < y AND y < bottom AND x1 < right AND x2 > left"))
    tall = upright.withColumns({"cell": first("x"), "row": _span("y1", "y2", cell)}).join(apart(held), ["cell", "row"])
    tall = tall.where((F.col("row") == F.greatest(first("y1"), first("top"))) & F.expr("left < x AND x < right AND y1 < bottom AND y2 > top"))
    return flat.select(F.col("h").alias("segment"), "block").unionAll(tall.select(F.col("v").alias("segment"), "block"))


def segments(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level and upright segments, as in ``crossings``, of routes (route, points of x and y); a segment is named by route and place. One without length is upright; slanted ones are left out."""
    pairs = F.arrays_zip(F.expr("slice(points, 1, size(points) - 1)").alias("a"), F.expr("slice(points, 2, size(points) - 1)").alias("b"))
    rows = routes.where("size(points) > 1").select("route", F.posexplode(pairs).alias("place", "s")).select(F.struct("route", "place").alias("id"), *[F.col(f"s.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    upright = rows.where("ax = bx").select(F.col("id").alias("v"), F.col("ax").alias("x"), F.least("ay", "by").alias("y1"), F.greatest("ay", "by").alias("y2"))
    return rows.where("ay = by AND ax <> bx").select(F.col("id").alias("h"), F.col("ay").alias("y"), F.least("ax", "bx").alias("x1"), F.greatest("ax", "bx").alias("x2")), upright


def route_metrics(routes: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row (crossings, bends, overlaps) of all routes.

    With whole coordinates pairs are counted by what covers the places of square cells, so that the work grows with the
    segments and blocks and not with the pairs, and a cell's rows are bounded; else, and for blocks without an inside, pairs are made.
    """
    level, upright = segments(routes)
    names = ["crossings", "bends", "overlaps"]
    part = lambda df, value, name: df.agg(value.alias("n")).select(*[(F.col("n") if name == c else F.lit(None).cast("long")).alias(c) for c in names])
    parts = part(routes, F.sum(F.greatest(F.size("points") - 2, F.lit(0)).cast("long")), "bends")
    flat = blocks
    if all(isinstance(f.dataType, IntegralType) for df in (level.select("y", "x1", "x2"), upright.select("x", "y1", "y2"), blocks.select("x1", "y1", "x2", "y2")) for f in df.schema):
        found = _counted(routes, blocks.where("x1 < x2 AND y1 < y2"))
        parts, flat = parts.unionAll(found.select("crossings", F.lit(None).cast("long"), "overlaps")), blocks.where("x1 >= x2 OR y1 >= y2")
    else:
        parts = parts.unionAll(part(crossings(level, upright), F.count("*"), "crossings"))
    if not flat.isEmpty():
        parts = parts.unionAll(part(overlaps(level, upright, flat), F.count("*"), "overlaps"))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def _marked(rows: DataFrame, low: str, high: str, starts: Column, goes: Column, only: Column | None = None) -> DataFrame:
    """``rows``, one for each mark (at, n, kind) of what covers the places from ``low`` to before ``high``: 1 where it starts, -1 behind its end, 1 where it goes on in a further cell; where ``only`` holds, the start alone."""
    first, more = F.shiftright(low, BITS), F.shiftright(high, BITS) - F.shiftright(low, BITS) + 1
    i = F.col("i")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), more if only is None else F.when(only, F.lit(0).cast("long")).otherwise(more))))
    at = F.when(i == 0, F.col(low)).when(i == 1, F.col(high)).otherwise(F.shiftleft(first + i - 1, BITS))
    return rows.withColumns({"at": at, "n": F.when(i == 1, -1).otherwise(1).cast("long"), "kind": F.when(i == 0, starts).otherwise(goes)}).drop("i")


def _counted(routes: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row (crossings, overlaps): as many as `crossings` and `overlaps` give pairs, for whole coordinates and blocks with an inside.

    A level segment crosses upright ones at places that both cover, ends left out. It runs through a block if it covers,
    its start included, a place of the block's left edge, corners left out, or else starts inside; so do upright ones, with
    the upper edge. Marks at one place are added up, so a cell has no more of them than places, whatever the number of
    segments; its sums along both axes say how many segments, edges and blocks cover each place.
    """
    long = lambda c: F.col(c).cast("long")
    pairs = F.arrays_zip(F.expr("slice(points, 1, size(points) - 1)").alias("a"), F.expr("slice(points, 2, size(points) - 1)").alias("b"))
    rows = routes.where("size(points) > 1").select(F.explode(pairs).alias("s")).select(*[long(f"s.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"]).where("ax = bx OR ay = by")
    level, dot = F.expr("ax <> bx"), F.expr("ax = bx AND ay = by")
    low = F.when(level, F.least("ax", "bx")).otherwise(F.least("ay", "by"))
    high = F.when(level, F.greatest("ax", "bx")).otherwise(F.greatest("ay", "by"))
    rows = rows.select(level.alias("level"), dot.alias("dot"), low.alias("low"), high.alias("high"), F.when(level, F.col("ay")).otherwise(F.col("ax")).alias("line"))
    kind = lambda of: F.when(F.col("level"), of["level"]).otherwise(of["upright"])
    rows = _marked(rows, "low", "high", F.when(F.col("dot"), DOT).otherwise(kind(START)), kind(GOES), F.col("dot"))
    drawn = rows.select(F.when(F.col("level"), F.col("at")).otherwise(F.col("line")).alias("x"), F.when(F.col("level"), F.col("line")).otherwise(F.col("at")).alias("y"), "kind", "n")
    held = blocks.select(long("x1").alias("left"), long("y1").alias("top"), long("x2").alias("right"), long("y2").alias("bottom"))
    held = held.withColumn("of", F.explode(F.array(F.lit(EDGE), F.lit(UPPER), F.lit(INSIDE))))
    edge, upper = F.col("of") == EDGE, F.col("of") == UPPER
    held = held.withColumns({"a": F.when(edge, F.col("left")).otherwise(F.col("left") + 1), "b": F.when(upper, F.col("top")).otherwise(F.col("top") + 1)})
    held = _marked(held, "a", "right", F.col("of"), F.col("of"), edge).withColumnsRenamed({"at": "x", "n": "m"})
    held = _marked(held, "b", "bottom", F.col("of"), F.col("of"), upper).select("x", F.col("at").alias("y"), "kind", (F.col("m") * F.col("n")).alias("n"))
    x, y, side = F.col("x"), F.col("y"), F.lit((1 << BITS) - 1)
    code = F.shiftleft(F.shiftleft(F.col("kind"), BITS) + x.bitwiseAND(side).cast("int"), BITS) + y.bitwiseAND(side).cast("int")
    marks = drawn.unionAll(held).select(F.shiftright(x, BITS).alias("cx"), F.shiftright(y, BITS).alias("cy"), code.alias("code"), "n")
    marks = marks.groupBy("cx", "cy", "code").agg(F.sum("n").alias("n")).where("n <> 0")
    n = tasks(routes.sparkSession)
    sums = marks.repartition(n, "cx", "cy").sortWithinPartitions("cx", "cy").mapInArrow(_cells, "crossings long, overlaps long")
    return sums.agg(F.sum("crossings").alias("crossings"), F.sum("overlaps").alias("overlaps"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(crossings, overlaps) of whole cells, from their marks (cx, cy, code, n) in order; some cells at once."""
    size, kinds = 1 << 2 * BITS, INSIDE + 1
    total, rest = np.zeros(2, np.int64), [np.zeros(0, np.int64)] * 4

    def add(cx, cy, code, n):
        if not len(cx):
            return
        starts = np.flatnonzero(np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])
        has = np.bitwise_or.reduceat(1 << (code >> 2 * BITS), starts)
        any_ = lambda *k: has & sum(1 << i for i in k) != 0
        level, upright = any_(START["level"], GOES["level"]), any_(START["upright"], GOES["upright"])
        use = level & upright | level & any_(EDGE) | upright & any_(UPPER) | any_(INSIDE) & (level | upright | any_(DOT))
        ends = np.r_[starts[1:], len(cx)]
        for i in range(0, len(starts), CELLS):
            some = [slice(a, b) for a, b, u in zip(starts[i : i + CELLS], ends[i : i + CELLS], use[i : i + CELLS]) if u]
            if not some:
                continue
            at = np.concatenate([k * kinds * size + code[s] for k, s in enumerate(some)])
            d = np.bincount(at, np.concatenate([n[s] for s in some]), len(some) * kinds * size).astype(np.int64).reshape(len(some), kinds, 1 << BITS, 1 << BITS)
            level_start, upright_start = d[:, START["level"]], d[:, START["upright"]]
            flat, tall = (level_start + d[:, GOES["level"]]).cumsum(axis=1), (upright_start + d[:, GOES["upright"]]).cumsum(axis=2)
            total[0] += ((flat - level_start) * (tall - upright_start)).sum()
            total[1] += (flat * d[:, EDGE].cumsum(axis=2)).sum() + (tall * d[:, UPPER].cumsum(axis=1)).sum()
            total[1] += (d[:, INSIDE].cumsum(axis=1).cumsum(axis=2) * (level_start + upright_start + d[:, DOT])).sum()

    for batch in batches:
        rows = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns)]
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) if len(rows[0]) else np.zeros(0, bool)
        cut_ = int(np.flatnonzero(~same)[-1] + 1) if not same.all() else 0  # the last cell may go on in the next batch
        add(*[r[:cut_] for r in rows])
        rest = [r[cut_:] for r in rows]
    add(*rest)
    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()) for t in total], names=["crossings", "overlaps"])


def layer_order(nodes: DataFrame, edges: DataFrame, rounds: int = 4) -> DataFrame:
    """``nodes`` (node, level, label) with ``place`` in its level, 0 first, by the mean place of neighbours.

    Starts by label; every round goes by predecessors in lower levels, then by successors in higher ones. Nodes without
    such neighbours come last, ties keep their places. Each half round places all levels at once from the places before.
    """
    by = lambda *o: F.row_number().over(Window.partitionBy("level").orderBy(*o)) - 1
    placed = cut(nodes.withColumn("place", by(F.lower("label"), "node")))
    for k in range(2 * rounds):
        mine, other = ("dst", "src") if k % 2 == 0 else ("src", "dst")
        far = placed.select(F.col("node").alias(other), F.col("level").alias("l"), F.col("place").alias("p"))
        here = placed.select(F.col("node").alias(mine), "level")
        means = edges.join(far, other).join(here, mine).where("l < level" if k % 2 == 0 else "l > level").groupBy(F.col(mine).alias("node")).agg(F.avg("p").alias("mean"))
        placed = cut(placed.join(means, "node", "left").withColumn("place", by(F.col("mean").asc_nulls_last(), "place")).drop("mean"))
    return placed


def module_order(nodes: DataFrame, edges: DataFrame, rounds: int = 4) -> DataFrame:
    """(module, node, level, place): each level's nodes in order, of nodes (module, node, level, label, region) and edges (module, src, dst).

    Levels start by region, label and name. A round goes down the levels and sorts each by the mean place of predecessors
    in lower ones, then up by that of successors in higher ones; nodes without any come last, ties go by region and label
    and else keep their order. So a level that has none in a pass, like the highest one on the way up, is put back. A level meets the places that the ones before it have just got, so a module is the work
    of one task, and modules are that of many. Edges to what isn't among the nodes are left out.
    """
    return _ordered(nodes.withColumn("region", F.coalesce("region", F.lit(""))), edges, rounds, fresh=True)


def instance_order(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(module, node, level, place) of nodes (module, node, level, label): as ``module_order``, but by label alone, ties keep their order, and a pass goes by the places from before it.

    So all levels of a pass could change places at once. Labels start in order whatever their case, then as they are, then by name.
    """
    return _ordered(nodes.withColumn("region", F.lit("")), edges, rounds, fresh=False)


def _ordered(nodes: DataFrame, edges: DataFrame, rounds: int, fresh: bool) -> DataFrame:
    """``fresh``: levels meet the places of the pass that they are in, and ties go by name; else they meet those from before it."""

    def placed(mine: list[tuple]) -> list[tuple]:
        level = {n: k for edge, n, _, k, *_ in mine if not edge}
        name = {n: (r, t.lower()) if fresh else (t.lower(), t) for edge, n, _, _, t, r in mine if not edge}
        links = [(a, b) for edge, a, b, *_ in mine if edge]
        before, after = {n: set() for n in level}, {n: set() for n in level}
        for a, b in links:
            if a in level and b in level and a != b:
                before[b].add(a)
                after[a].add(b)
        rows: dict = {}
        for n in sorted(level, key=lambda n: (*name[n], n)):
            rows.setdefault(level[n], []).append(n)
        place = {n: i for row in rows.values() for i, n in enumerate(row)}

        def settle(k, near, ahead, seen):
            def mean(n):
                found = [seen[x] for x in near[n] if ahead(level[x], k)]
                tie = name[n] if fresh else ()
                return (False, sum(found) / len(found), *tie) if found else (True, 0.0, *tie)

            rows[k] = sorted(rows[k], key=mean)
            place.update((n, i) for i, n in enumerate(rows[k]))

        for _ in range(rounds):
            for near, ahead, back in ((before, operator.lt, False), (after, operator.gt, True)):
                seen = place if fresh else dict(place)
                for k in sorted(rows, reverse=back):
                    settle(k, near, ahead, seen)
        return [(n, level[n], place[n]) for n in level]

    kinds = dict(nodes.dtypes)
    one = nodes.select("module", F.lit(False).alias("edge"), "node", F.col("node").alias("to"), "level", F.coalesce("label", F.lit("")).alias("label"), "region").where("node IS NOT NULL").dropDuplicates(["module", "node"])
    links = edges.select("module", F.lit(True), "src", "dst", F.lit(0).cast(kinds["level"]), F.lit(""), F.lit("")).where("src IS NOT NULL AND dst IS NOT NULL")
    rows = one.unionAll(links).where("module IS NOT NULL")
    return by_module(rows, placed, f"node {kinds['node']}, level {kinds['level']}, place long")


def boxes(placed: DataFrame, ports: DataFrame, column: int = 300, row: int = 160) -> DataFrame:
    """``layer_order`` with x, y, width and height; a block is as high as the side with more of its ``ports`` (node, side) needs."""
    sides = ports.groupBy("node", "side").count().groupBy("node").agg(F.max("count").alias("most"))
    high = F.greatest(F.lit(84), F.lit(54) + 24 * F.coalesce("most", F.lit(0)))
    return placed.join(sides, "node", "left").withColumns({"x": F.col("level") * column, "y": F.col("place") * row, "width": F.lit(220), "height": high}).drop("most")
