"""Routes of nets over placed blocks: straight or bent once, along lanes, or by name at both ends; hits and metrics by a grid.

All is by module, and a net's lines are rows, so neither a module nor a net of many sinks is one task's work. Segments
and boxes meet in the cells of a grid over both axes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import by_words, snap

from .graphs import apart, cut

# Words of nets that are drawn along the top, and where lanes start and how far apart they are.
TOP_WORDS = ["clk", "clock", "rst", "reset", "start", "enable", "valid", "ready", "busy"]
LANES = {"control": (60, 24), "bus": (160, 28), "wire": (120, 28)}
#: A net is drawn by name if it goes back, has several sinks, or reaches farther than this.
LONG_SPAN = 350
CELL = 256
LINE = ["module", "net", "line"]


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))


def anchors(ports: DataFrame) -> DataFrame:
    """(module, endpoint, block, px, py): where lines meet ports (module, endpoint, kind, side, x, y, width, parent): outside of pins, at the inner edge of a module's own ports."""
    left = F.col("side") == "left"
    half = F.floor(F.col("width") / 2)
    x = F.when(F.col("kind") == "module_io", F.col("x") + F.when(left, half).otherwise(-half)).otherwise(F.col("x") + F.when(left, -18).otherwise(18))
    return ports.select("module", "endpoint", F.coalesce("parent", "endpoint").alias("block"), x.cast("long").alias("px"), F.col("y").cast("long").alias("py"))


def boxes(blocks: DataFrame) -> DataFrame:
    """(module, block, left, top, right, bottom) of blocks given by their centres."""
    w, h = F.floor(F.col("width") / 2), F.floor(F.col("height") / 2)
    return blocks.select("module", "block", (F.col("x") - w).alias("left"), (F.col("y") - h).alias("top"), (F.col("x") + w).alias("right"), (F.col("y") + h).alias("bottom"))


def segments(lines: DataFrame) -> DataFrame:
    """(module, net, line, place, level, x1, y1, x2, y2) of the level and upright parts of lines; those without length are upright."""
    pairs = F.arrays_zip(F.expr("slice(points, 1, size(points) - 1)").alias("a"), F.expr("slice(points, 2, size(points) - 1)").alias("b"))
    rows = lines.where("size(points) > 1").select(*LINE, F.posexplode(pairs).alias("place", "s")).where("s.a.x = s.b.x OR s.a.y = s.b.y")
    end = lambda f, c: f(F.col(f"s.a.{c}"), F.col(f"s.b.{c}"))
    return rows.select(*LINE, "place", F.expr("s.a.x <> s.b.x").alias("level"), end(F.least, "x").alias("x1"), end(F.least, "y").alias("y1"), end(F.greatest, "x").alias("x2"), end(F.greatest, "y").alias("y2"))


def in_cells(df: DataFrame, x1: str, y1: str, x2: str, y2: str, cell: int) -> DataFrame:
    """A row for each cell (cx, cy) of the grid that the rectangle touches."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return df.withColumn("cx", span(x1, x2)).withColumn("cy", span(y1, y2))


def hits(parts: DataFrame, around: DataFrame, cell: int = CELL) -> DataFrame:
    """(module, net, line, place, block): segments that run through the inside of a box, each pair once, from the first cell that both touch."""
    held = in_cells(around, "left", "top", "right", "bottom", cell)
    both = in_cells(parts, "x1", "y1", "x2", "y2", cell).join(apart(held), ["module", "cx", "cy"])
    inside = F.expr("CASE WHEN level THEN top < y1 AND y1 < bottom AND x1 < right AND x2 > left ELSE left < x1 AND x1 < right AND y1 < bottom AND y2 > top END")
    first = (F.col("cx") == F.greatest(F.floor(F.col("x1") / cell), F.floor(F.col("left") / cell))) & (F.col("cy") == F.greatest(F.floor(F.col("y1") / cell), F.floor(F.col("top") / cell)))
    return both.where(inside & first).select(*LINE, "place", "block")


def blocks_at(points: DataFrame, around: DataFrame, cell: int = CELL) -> DataFrame:
    """The points (module, x, y, …) with the boxes that they lie in, borders included; a point is in one cell, so each pair comes once."""
    held = in_cells(around, "left", "top", "right", "bottom", cell)
    at = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return at.join(apart(held), ["module", "cx", "cy"]).where("left <= x AND x <= right AND top <= y AND y <= bottom").select(*points.columns, "block")


def segments_at(points: DataFrame, parts: DataFrame, reach: int = 6, cell: int = CELL) -> DataFrame:
    """The points (module, x, y, …) with the segments no farther than ``reach`` from them on either axis."""
    wide = parts.select("*", (F.col("x1") - reach).alias("left"), (F.col("y1") - reach).alias("top"), (F.col("x2") + reach).alias("right"), (F.col("y2") + reach).alias("bottom"))
    at = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return at.join(apart(in_cells(wide, "left", "top", "right", "bottom", cell)), ["module", "cx", "cy"]).where("left <= x AND x <= right AND top <= y AND y <= bottom").select(*points.columns, "net", "line", "place")


def _nets(edges: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nets with their first source and what is known of their sinks; and the sinks (module, net, k, tx, ty, target_block), k by place from the top."""
    ordered = edges.groupBy("module", "net").agg(*[F.min_by(c, "ord").alias(c) for c in ("source", "sig_class", "bit_width")])
    sinks = edges.select("module", "net", F.col("target").alias("endpoint")).distinct().join(apart(ends), ["module", "endpoint"])
    sinks = sinks.withColumn("k", F.row_number().over(Window.partitionBy("module", "net").orderBy("py", "endpoint")) - 1)
    sinks = sinks.select("module", "net", "k", F.col("px").alias("tx"), F.col("py").alias("ty"), F.col("block").alias("target_block"))
    facts = sinks.groupBy("module", "net").agg(F.count("*").alias("fanout"), F.max("tx").alias("most_x"), F.min("tx").alias("least_x"), F.avg("ty").alias("mean_y"))
    start = ends.select("module", F.col("endpoint").alias("source"), F.col("px").alias("sx"), F.col("py").alias("sy"), F.col("block").alias("source_block"))
    plain = F.translate(F.lower(F.trim("net")), "-", "_")
    kind = by_words(plain, [("control", TOP_WORDS)], F.when(F.col("bit_width") > 1, "bus").otherwise("wire"))
    nets = ordered.join(apart(start), ["module", "source"]).join(apart(facts), ["module", "net"]).withColumn("kind", kind)
    named = (F.abs(F.greatest("most_x", "sx") - F.col("sx")) > LONG_SPAN) | (F.col("least_x") < F.col("sx")) | (F.col("fanout") > 1)
    text = F.when((F.col("fanout") == 1) | (F.col("kind") == "control") | (F.col("bit_width") > 1), F.col("net")).otherwise(F.concat("net", F.lit(" x"), F.col("fanout")))
    return nets.withColumn("named", named).withColumn("label", text), sinks


def _lines(both: DataFrame, *made: tuple[int | Column, list[Column]]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("line") if isinstance(n, int) else n.cast("long").alias("line"), F.array(*points).alias("points")) for n, points in made]))
    return both.select("module", "net", each.alias("l")).select("module", "net", "l.line", "l.points").distinct()


def _bent(sx: str, sy: str, tx: str, ty: str) -> list[Column]:
    mid = snap((F.col(sx) + F.col(tx)) / 2)
    return [_point(F.col(sx), F.col(sy)), _point(mid, F.col(sy)), _point(mid, F.col(ty)), _point(F.col(tx), F.col(ty))]


def routes(edges: DataFrame, ports: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nets, lines) of edges (module, ord, net, source, target, sig_class, bit_width) between placed ports and blocks.

    nets: (module, net, label, kind, way, lane_y); lines: (module, net, line, points). ``way`` is direct, lane or named.
    Nets that go back, far, or to several sinks are named: stubs at both ends. Of the others, a plain wire goes straight
    (ends up to 8 apart in height) or by one bend, unless that runs through a block that it doesn't connect. Then, and
    for buses and control nets, it takes the next lane of its kind, by the order of names; if that runs through a block
    too, it is named. Ends without a place are left out.
    """
    nets, sinks = _nets(edges, anchors(ports))
    both = cut(nets.join(apart(sinks), ["module", "net"]))
    joined = both.select("module", "net", F.explode(F.array("source_block", "target_block")).alias("block")).distinct()
    around = boxes(blocks)

    def blocked(lines: DataFrame) -> DataFrame:
        """(module, net) of lines through blocks that their nets don't connect."""
        return hits(segments(lines), around).join(apart(joined), ["module", "net", "block"], "left_anti").select("module", "net").distinct()

    one = both.where("NOT named")
    wires = one.where("kind = 'wire'")
    flat = F.abs(F.col("sy") - F.col("ty")) <= 8
    ends = [_point(F.col("sx"), F.col("sy")), _point(F.col("tx"), F.col("ty"))]
    tried = _lines(wires.where(flat), (0, ends)).unionAll(_lines(wires.where(~flat), (0, _bent("sx", "sy", "tx", "ty"))))
    direct = cut(tried.join(apart(blocked(tried)), ["module", "net"], "left_anti"))
    rest = one.join(apart(direct.select("module", "net")), ["module", "net"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("module", "kind").orderBy(F.col("net").cast("binary"))) - 1
    by_kind = None
    for k, (first, gap) in LANES.items():
        y = F.lit(first) + turn * gap
        y = F.greatest(y, snap(F.col("mean_y"))) if k == "wire" else y
        by_kind = F.when(F.col("kind") == k, y) if by_kind is None else by_kind.when(F.col("kind") == k, y)
    rest = rest.withColumn("lane_y", snap(by_kind)).withColumn("from_x", snap(F.col("sx") + 36)).withColumn("to_x", F.greatest(F.col("from_x") + 20, snap(F.col("most_x") - 32))).withColumn("join_x", snap(F.col("tx") - 28))
    rest = cut(rest)
    lane = _lines(
        rest, (0, [_point(F.col("sx"), F.col("sy")), _point(F.col("from_x"), F.col("sy")), _point(F.col("from_x"), F.col("lane_y"))]), (1, [_point(F.col("from_x"), F.col("lane_y")), _point(F.col("to_x"), F.col("lane_y"))]),
        (F.col("k") + 2, [_point(F.col("join_x"), F.col("lane_y")), _point(F.col("join_x"), F.col("ty")), _point(F.col("tx"), F.col("ty"))]),
    )
    lane = cut(lane.join(apart(blocked(lane)), ["module", "net"], "left_anti"))
    laid = lane.select("module", "net").distinct()
    by_name = both.where("named").select(*both.columns).unionByName(rest.join(apart(laid), ["module", "net"], "left_anti").select(*both.columns))
    stubs = _lines(
        by_name, (F.col("k") * 2, [_point(F.col("sx"), F.col("sy")), _point(F.col("sx") + 28, F.col("sy"))]), (F.col("k") * 2 + 1, [_point(F.col("tx") - 28, F.col("ty")), _point(F.col("tx"), F.col("ty"))]),
    )
    way = direct.select("module", "net", F.lit("direct").alias("way"), F.lit(None).cast("long").alias("lane_y"))
    way = way.unionAll(rest.join(apart(laid), ["module", "net"], "left_semi").select("module", "net", F.lit("lane"), "lane_y")).unionAll(by_name.select("module", "net", F.lit("named"), F.lit(None).cast("long"))).distinct()
    named = both.select("module", "net", "label", "kind").distinct()
    return named.join(apart(way), ["module", "net"]).select("module", "net", "label", "kind", "way", "lane_y"), direct.unionAll(lane).unionAll(stubs)


def plain_lines(edges: DataFrame, ports: DataFrame) -> DataFrame:
    """Lines of one bend for every edge, against which routes are measured; ``line`` is the edge's ord."""
    ends = anchors(ports)
    of = lambda name, x, y: ends.select("module", F.col("endpoint").alias(name), F.col("px").alias(x), F.col("py").alias(y))
    both = edges.join(apart(of("source", "sx", "sy")), ["module", "source"]).join(apart(of("target", "tx", "ty")), ["module", "target"])
    return both.select("module", "net", F.col("ord").cast("long").alias("line"), F.array(*_bent("sx", "sy", "tx", "ty")).alias("points"))


def metrics(lines: DataFrame, blocks: DataFrame, cell: int = CELL) -> DataFrame:
    """(module, crossings, bends, overlaps) of the modules that have lines.

    A level and an upright segment cross in one point, inside of both, which lies in one cell.
    """
    parts = segments(lines)
    flat = in_cells(parts.where("level").select("module", "x1", "x2", F.col("y1").alias("y"), F.col("y1").alias("yy")), "x1", "y", "x2", "yy", cell)
    tall = in_cells(parts.where("NOT level").select("module", F.col("x1").alias("x"), F.col("x1").alias("xx"), F.col("y1").alias("lo"), F.col("y2").alias("hi")), "x", "lo", "xx", "hi", cell)
    crossed = flat.join(apart(tall), ["module", "cx", "cy"]).where(f"x1 < x AND x < x2 AND lo < y AND y < hi AND cx = floor(x / {cell}) AND cy = floor(y / {cell})").groupBy("module").agg(F.count("*").alias("crossings"))
    bends = lines.groupBy("module").agg(F.sum(F.greatest(F.size("points") - 2, F.lit(0)).cast("long")).alias("bends"))
    over = hits(parts, boxes(blocks), cell).groupBy("module").agg(F.count("*").alias("overlaps"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return bends.join(apart(crossed), "module", "left").join(apart(over), "module", "left").select("module", zero("crossings"), "bends", zero("overlaps"))


def improvement(edges: DataFrame, lines: DataFrame, ports: DataFrame, blocks: DataFrame) -> DataFrame:
    """(module, crossings_reduced_by, bends_reduced_by, overlaps_reduced_by) of routes against plain lines."""
    before, after = metrics(plain_lines(edges, ports), blocks), metrics(lines, blocks)
    less = lambda c: (before[c] - F.coalesce(after[c], F.lit(0))).alias(f"{c}_reduced_by")
    return before.join(apart(after), "module", "left").select(before["module"], less("crossings"), less("bends"), less("overlaps"))
