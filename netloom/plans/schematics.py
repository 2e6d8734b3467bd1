"""Queries of schematic views on circuits made of ``part``, beside SQL that states the results by hand.

Each part has the circuit of ``NODES`` and ``EDGES`` with its key in front of all names; every third one has no ports of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import design, geometry, graphs, routes, schematic
from ..sources import files as project_files
from ..sources import rtl
from .reports import _t, _values

_Q: dict = {}


def _query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = (f, sql)
        return f

    return keep


# Name, kind, parent, direction. 2 and 3 feed each other, as do 6 and 7, which 5 feeds.
NODES = [(b, "instance", None, None) for b in "123456789x"]
NODES += [(f"{b}{p}", "instance_port", b, "output" if p == "o" else "Input") for b in "123456789x" for p in "io"] + [("8p", "instance_port", "8", "output"), ("9j", "instance_port", "9", "input"), ("xj", "instance_port", "x", "input"), ("7j", "instance_port", "7", "input")]
NODES += [("in", "module_io", None, "input"), ("out", "module_io", None, "output")]
# Name, source, target, nets.
EDGES = [
    ("e01", "1o", "2i", "a"), ("e02", "2o", "3i", "b"), ("e03", "3o", "2i", "c"), ("e04", "3o", "4i", "c"), ("e05", "in", "1i", "d"), ("e06", "1o", "4i", "a"), ("e07", "8o", "9i", None), ("e08", "8o", "9j", "e"),
    ("e09", "9o", "xi", "f"), ("e10", "8o", "xj", "g g2 g3"), ("e11", "8p", "9j", "h"), ("e12", "5o", "7i", "k"), ("e13", "7o", "6i", "l"), ("e14", "6o", "7j", "m"),
]
# Worked out by hand: how an edge is shown by itself, why, and beside others. Routing has 6 at 0 and 7 at 1, as no round places them.
ROUTED = [
    ("e01", "netlabel", "fanout", "netlabel"), ("e02", "netlabel", "feedback", "netlabel"), ("e03", "netlabel", "fanout", "netlabel"), ("e04", "netlabel", "fanout", "netlabel"), ("e05", "netlabel", "boundary", "netlabel"), ("e06", "netlabel", "fanout", "netlabel"),
    ("e07", "routed", "single", "routed"), ("e08", "routed", "single", "netlabel"), ("e09", "routed", "single", "routed"), ("e10", "netlabel", "long", "netlabel"), ("e11", "routed", "single", "netlabel"), ("e12", "routed", "single", "routed"), ("e13", "netlabel", "feedback", "netlabel"), ("e14", "routed", "single", "routed"),
]
LEVELS = [("1", 0), ("2", 1), ("3", 2), ("4", 3), ("5", 0), ("6", 2), ("7", 3), ("8", 0), ("9", 1), ("x", 2)]
LABELS = [
    ("source", "1o", "a", "a", "fanout"), ("source", "2o", "b", "b", "feedback"), ("source", "3o", "c", "c", "fanout"), ("source", "in", "d", "d", "boundary"), ("source", "8o", "e", "e", "single"), ("source", "8o", "g", "g +2", "long"), ("source", "8p", "h", "h", "single"), ("source", "7o", "l", "l", "feedback"),
    ("target", "2i", "a", "a", "fanout"), ("target", "3i", "b", "b", "feedback"), ("target", "2i", "c", "c", "fanout"), ("target", "4i", "c", "c", "fanout"), ("target", "1i", "d", "d", "boundary"), ("target", "4i", "a", "a", "fanout"), ("target", "9j", "e", "e", "single"), ("target", "xj", "g", "g +2", "long"), ("target", "9j", "h", "h", "single"), ("target", "6i", "l", "l", "feedback"),
]
DOWN = [("1i", 0, False), ("1o", 0, True), ("2i", 1, False), ("4i", 1, False), ("2o", 1, True), ("4o", 1, True), ("3i", 2, False), ("3o", 2, True)]
UP = [("2o", 0, False), ("2i", 0, True), ("1o", 1, False), ("3o", 1, False), ("1i", 1, True), ("3i", 1, True), ("in", 2, False)]
_OWN = "p_partkey % 3 <> 0"


def _parts(s, d):
    return _t(s, d, "part").select(F.col("p_partkey").alias("module"))


def _of_each(s, d, rows: list, names: list[str]):
    """A row for each part and each of ``rows``; parts are dealt to tasks first, since the one file of a table is read by few."""
    value = lambda x: F.lit(x).cast("string") if x is None else F.lit(x)
    return _parts(s, d).repartition(rtl.tasks(s), "module").select("module", F.posexplode(F.array(*[F.struct(*[value(x).alias(n) for x, n in zip(r, names)]) for r in rows])).alias("ord", "r")).select("module", "ord", "r.*")


def _own(df, *names):
    return df.withColumns({n: F.concat(F.col("module").cast("string"), F.lit("."), F.col(n)) for n in names})


def _nodes(s, d):
    return _own(_of_each(s, d, NODES, ["id", "kind", "parent", "direction"]), "id", "parent").where("module % 3 <> 0 OR kind <> 'module_io'")


def _edges(s, d):
    e = _of_each(s, d, EDGES, ["id", "src", "dst", "nets"]).where("module % 3 <> 0 OR src <> 'in'")
    return _own(e.withColumn("nets", F.split("nets", " ")).withColumn("net", F.get("nets", F.lit(0))), "id", "src", "dst")


def _sql(rows: list, names: str, select: str, where: str = "true") -> str:
    return f"WITH v(n, {names}) AS (VALUES {_values(rows)}) SELECT {select} FROM part, v WHERE {where}"


def _id(name: str) -> str:
    return f"p_partkey || '.' || {name}"


@_query(_sql(LEVELS, "node, level", f"{_id('node')} AS node, CAST(level AS BIGINT) AS level"))
def instance_levels(s, d):
    return schematic.instance_levels(_nodes(s, d), _edges(s, d)).select("node", F.col("level").cast("bigint").alias("level"))


@_query(_sql(NODES, "id, kind, parent, direction", f"p_partkey AS module, {_id('id')} AS id", f"CASE WHEN {_OWN} THEN id = 'in' ELSE kind = 'instance' END"))
def layout_roots(s, d):
    return schematic.layout_roots(_nodes(s, d), _edges(s, d))


@_query(_sql(ROUTED, "id, mode, reason, final", f"{_id('id')} AS id, mode, reason", f"{_OWN} OR id <> 'e05'"))
def edge_routing(s, d):
    return schematic.edge_routing(_nodes(s, d), _edges(s, d)).select("id", "mode", "reason")


@_query(_sql(ROUTED, "id, mode, reason, final", f"{_id('id')} AS id, final AS mode, reason", f"{_OWN} OR id <> 'e05'"))
def edge_modes(s, d):
    return schematic.final_modes(schematic.edge_routing(_nodes(s, d), _edges(s, d))).select("id", "mode", "reason")


@_query(_sql(LABELS, "role, port, net, text, reason", f"role, {_id('port')} AS port, net, text, reason", f"{_OWN} OR net <> 'd'"))
def net_labels(s, d):
    return schematic.net_labels(schematic.final_modes(schematic.edge_routing(_nodes(s, d), _edges(s, d))))


@_query(_sql([("4o",), ("xo",), ("5i",), ("8i",), ("1i",), ("out",)], "id", f"{_id('id')} AS id", f"CASE id WHEN '1i' THEN NOT ({_OWN}) WHEN 'out' THEN {_OWN} ELSE true END"))
def unconnected_ports(s, d):
    return schematic.unconnected(_nodes(s, d), _edges(s, d)).select("id")


@_query(_sql([("2", "e01"), ("2", "e02"), ("2", "e03"), ("in", "e05")], "start, id", f"{_id('start')} AS start, {_id('id')} AS id", f"{_OWN} OR start = '2'"))
def neighbourhoods(s, d):
    starts = _own(_of_each(s, d, [("2",), ("in",)], ["node"]), "node").select("node")
    return schematic.neighbourhood(_nodes(s, d), _edges(s, d), starts)


@_query(_sql([("e03", "e03"), ("e03", "e04"), ("e07", "e07")], "start, id", f"{_id('start')} AS start, {_id('id')} AS id"))
def same_net_edges(s, d):
    return schematic.same_net(_edges(s, d), _own(_of_each(s, d, [("e03",), ("e07",)], ["id"]), "id"))


def _traced(df):
    return df.select("start", "port", F.col("depth").cast("bigint").alias("depth"), "crossed")


@_query(_sql(DOWN, "port, depth, crossed", f"{_id(chr(39) + 'in' + chr(39))} AS start, {_id('port')} AS port, CAST(depth AS BIGINT) AS depth, crossed", _OWN))
def port_trace_down(s, d):
    return _traced(schematic.port_trace(_nodes(s, d), _edges(s, d), _nodes(s, d).where("kind = 'module_io' AND direction = 'input'").select(F.col("id").alias("node"))))


@_query(_sql(UP, "port, depth, crossed", f"{_id(chr(39) + '3i' + chr(39))} AS start, {_id('port')} AS port, CAST(depth AS BIGINT) AS depth, crossed", f"{_OWN} OR port <> 'in'"))
def port_trace_up(s, d):
    return _traced(schematic.port_trace(_nodes(s, d), _edges(s, d), _own(_of_each(s, d, [("3i",)], ["node"]), "node").select("node"), downstream=False))


# Name, direction, bus. Worked out by hand: side, place on it, label without regard to the number of ports.
PORTS = [("b_in", "input", True, "left", 3), ("Clk", "input", False, "left", 0), ("rst-n", None, False, "left", 1), ("zz", "inout", False, "left", 4), ("start", "Input", False, "left", 2), ("q", "output", False, "right", 0)]


@_query(_sql(PORTS, "name, direction, is_bus, side, place", f"{_id('name')} AS id, side, CAST(round_even((p_partkey + CASE side WHEN 'left' THEN -110.0 ELSE 110.0 END) / 20, 0) * 20 AS BIGINT) AS x, CAST(round_even((p_size - (84 + 10 * p_size) / 2.0 + 28 + place * CASE side WHEN 'left' THEN greatest(20.0, (28 + 10 * p_size) / 4.0) ELSE 0 END) / 20, 0) * 20 AS BIGINT) AS y, true AS label_visible"))
def port_places(s, d):
    blocks = _t(s, d, "part").select(F.col("p_partkey").cast("string").alias("node"), F.col("p_partkey").alias("x"), F.col("p_size").alias("y"), F.lit(220).alias("width"), (84 + 10 * F.col("p_size")).alias("height"))
    ports = _of_each(s, d, [p[:3] for p in PORTS], ["name", "direction", "is_bus"]).withColumns({"id": F.concat(F.col("module").cast("string"), F.lit("."), F.col("name")), "parent": F.col("module").cast("string")})
    return schematic.port_places(blocks, ports).drop("parent")


@_query("SELECT p_brand AS region, count(*) AS blocks FROM part GROUP BY 1 HAVING count(*) >= 12")
def crowded_regions(s, d):
    return schematic.crowded_regions(_t(s, d, "part").select(F.col("p_brand").alias("region")))


_TITLES = [("input_interface", "Input Interface"), ("decode_control", "Decode / Control"), ("alu_datapath", "ALU / Datapath"), ("registers", "Registers / State"), ("memory_interface", "Memory / Interface"), ("output_interface", "Output Interface"), ("logic", "Logic"), ("other", "Logic")]


@_query(f"WITH v(n, region, title) AS (VALUES {_values(_TITLES)}) SELECT p_partkey, title FROM part JOIN v ON n = p_partkey % {len(_TITLES)}")
def region_titles(s, d):
    key = F.get(F.array(*[F.lit(r) for r, _ in _TITLES]), (F.col("p_partkey") % len(_TITLES)).cast("int"))
    return _t(s, d, "part").select("p_partkey", scalars.region_title(key).alias("title"))


# Always blocks with the module's key for #. Worked out by hand: controls, lines, written, read.
BLOCKS = [
    ("always @(posedge c) if (a) b <= d# + 1; else b <= 0;", "if (a) / else", "b <= d# + 1 when a|b <= 0 when !(a)", "b", "d#,a"),
    ("always @(*) begin m[i] = a & d#; begin if (c) b = a; b = c; end case (s) 0: b = a; 1: begin if (i) b = c; end default: b = m; endcase end", "m[i] = a & d#|if (c)|case (s) [3 arms]", "m[i] = a & d#|b = a when c|b = c|b = a when s|b = c when i|b = m when s", "m,i,b", "a,d#,c,s,i,m"),
    ("always @(*) casez (s) 1: b = a; endcase", "", "b = a when s", "b", "a,s"),
    ("always @(c) begin b = a; b = a; b = 1; b = 2; b = 3; b = 4; b = 5; b = 6; b = 7; b = other; end", "b = a|b = a|b = 1|b = 2|b = 3|b = 4", "b = a|b = 1|b = 2|b = 3|b = 4|b = 5|b = 6|b = 7", "b", "a,b"),
]


@_query(f"WITH v(n, text, controls, lines, written, read) AS (VALUES {_values(BLOCKS)}) SELECT 'p' || p_partkey AS module, replace(controls, '#', CAST(p_partkey AS VARCHAR)) AS controls, replace(lines, '#', CAST(p_partkey AS VARCHAR)) AS lines, written, replace(read, '#', CAST(p_partkey AS VARCHAR)) AS read FROM part JOIN v ON n = p_partkey % {len(BLOCKS)}")
def rtl_block_summaries(s, d):
    k = F.col("p_partkey")
    body = F.get(F.array(*[F.lit(b[0]) for b in BLOCKS]), (k % len(BLOCKS)).cast("int"))
    text = F.replace(F.concat(F.lit("module p# (input a, input c, input [3:0] d#, input s, input i, output reg b);\n  reg [7:0] m;\n  "), body, F.lit("\nendmodule\n")), F.lit("#"), k.cast("string"))
    found = design.block_summaries(design.catalog(rtl.modules(_t(s, d, "part").select(F.concat(F.lit("p"), k.cast("string"), F.lit(".v")).alias("path"), text.alias("text")))))
    return found.select("module", F.array_join("control_summary", "|").alias("controls"), F.array_join("summary_lines", "|").alias("lines"), F.array_join("written", ",").alias("written"), F.array_join("read", ",").alias("read"))


# Worked out by hand: path with the key for #, whether it is compiled.
PATHS = [("rtl/f#.v", True), ("Rtl/f#.SV", True), ("testbenches/t#.v", False), (".git/x#.v", False), ("rtl/.h/x#.v", False), ("doc/n#.txt", False), ("rtl/testbenches/t#.v", True), (".f#.v", False), ("rtl/f#.svh", False), ("rtl/.v", False)]


@_query(f"WITH v(n, path, compiled) AS (VALUES {_values(PATHS)}) SELECT replace(path, '#', CAST(p_partkey AS VARCHAR)) AS path FROM part JOIN v ON n = p_partkey % {len(PATHS)} WHERE compiled AND p_size % 9 <> 0")
def compile_sources(s, d):
    path = F.replace(F.get(F.array(*[F.lit(p) for p, _ in PATHS]), (F.col("p_partkey") % len(PATHS)).cast("int")), F.lit("#"), F.col("p_partkey").cast("string")).alias("path")
    part = _t(s, d, "part")
    return project_files.compile_sources(part.select(path), part.where("p_size % 9 = 0").select(path))


# Routes of three points, level and then upright, and boxes.
_ROUTES = "r AS (SELECT o_orderkey AS k, CAST(o_orderkey * 37 % 4000 AS BIGINT) AS x1, CAST(o_custkey * 53 % 4000 AS BIGINT) AS y1, CAST(o_orderkey * 37 % 4000 + o_custkey % 90 AS BIGINT) AS x2, CAST(o_custkey * 53 % 4000 + o_orderkey % 70 AS BIGINT) AS y2 FROM orders), b AS (SELECT p_partkey AS block, CAST(p_partkey * 61 % 4000 AS BIGINT) AS bx1, CAST(p_partkey * 17 % 4000 AS BIGINT) AS by1, CAST(p_partkey * 61 % 4000 + 100 AS BIGINT) AS bx2, CAST(p_partkey * 17 % 4000 + 60 AS BIGINT) AS by2 FROM part), l AS (SELECT k, y1 AS y, x1 AS a, x2 AS b FROM r WHERE x1 <> x2), u AS (SELECT k, x2 AS x, y1 AS a, y2 AS b FROM r UNION ALL SELECT k, x1, y1, y1 FROM r WHERE x1 = x2)"


@_query(f"WITH {_ROUTES} SELECT (SELECT count(*) FROM l JOIN u ON l.a < u.x AND u.x < l.b AND u.a < l.y AND l.y < u.b) AS crossings, (SELECT count(*) FROM r) AS bends, (SELECT count(*) FROM l JOIN b ON by1 < y AND y < by2 AND l.a < bx2 AND l.b > bx1) + (SELECT count(*) FROM u JOIN b ON bx1 < x AND x < bx2 AND u.a < by2 AND u.b > by1) AS overlaps")
def route_metrics(s, d):
    o, p = F.col("o_orderkey"), F.col("p_partkey")
    x, y = o * 37 % 4000, F.col("o_custkey") * 53 % 4000
    at = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    far = x + F.col("o_custkey") % 90
    routes = _t(s, d, "orders").select(o.alias("route"), F.array(at(x, y), at(far, y), at(far, y + o % 70)).alias("points"))
    blocks = _t(s, d, "part").select(p.alias("block"), (p * 61 % 4000).alias("x1"), (p * 17 % 4000).alias("y1"), (p * 61 % 4000 + 100).alias("x2"), (p * 17 % 4000 + 60).alias("y2"))
    return geometry.route_metrics(routes, blocks)


# A module's blocks by their centres, its ports, its edges, and the routes worked out by hand.
PLACED = [("A", 100, 200, 80, 100), ("B", 400, 200, 80, 100), ("C", 250, 320, 60, 60), ("D", 400, 420, 80, 100), ("E", 400, 310, 80, 40)]
PLACED_PORTS = [(f"{b}.{p}", "instance", side, x, y, None, b) for b, p, side, x, y in (
    ("A", "o1", "right", 140, 180), ("A", "o2", "right", 140, 200), ("A", "o3", "right", 140, 230), ("A", "o4", "right", 140, 240), ("B", "i1", "left", 360, 180), ("B", "i2", "left", 360, 215),
    ("B", "i3", "left", 360, 240), ("D", "i1", "left", 360, 400), ("D", "i2", "left", 360, 440), ("D", "o1", "right", 440, 420), ("E", "i1", "left", 360, 320))] + [("in0", "module_io", "left", 20, 500, 40, None)]
WIRES = [
    ("n_direct", "A.o1", "B.i1", 1), ("n_ell", "A.o2", "B.i2", 1), ("clk", "A.o3", "B.i3", 1), ("bus8", "A.o4", "D.i1", 8), ("n_blocked", "A.o4", "D.i2", 1), ("n_wall", "A.o4", "E.i1", 1),
    ("n_fan", "A.o1", "B.i1", 1), ("n_fan", "A.o1", "D.i1", 1), ("n_back", "D.o1", "B.i1", 1), ("n_long", "in0", "D.o1", 1),
]
ROUTED = [
    ("n_direct", "direct", 0, "158,180 342,180"), ("n_ell", "direct", 0, "158,200 240,200 240,215 342,215"),
    ("clk", "lane", 0, "158,230 200,230 200,60"), ("clk", "lane", 1, "200,60 320,60"), ("clk", "lane", 2, "320,60 320,240 342,240"),
    ("bus8", "lane", 0, "158,240 200,240 200,160"), ("bus8", "lane", 1, "200,160 320,160"), ("bus8", "lane", 2, "320,160 320,400 342,400"),
    ("n_blocked", "lane", 0, "158,240 200,240 200,440"), ("n_blocked", "lane", 1, "200,440 320,440"), ("n_blocked", "lane", 2, "320,440 320,440 342,440"),
    ("n_wall", "named", 0, "158,240 186,240"), ("n_wall", "named", 1, "314,320 342,320"),
    ("n_fan", "named", 0, "158,180 186,180"), ("n_fan", "named", 1, "314,180 342,180"), ("n_fan", "named", 2, "158,180 186,180"), ("n_fan", "named", 3, "314,400 342,400"),
    ("n_back", "named", 0, "458,420 486,420"), ("n_back", "named", 1, "314,180 342,180"), ("n_long", "named", 0, "40,500 68,500"), ("n_long", "named", 1, "430,420 458,420"),
]


def _layout(s, d):
    """The same layout for each part, as a module of its own."""
    parts = _parts(s, d).repartition(rtl.tasks(s), "module")
    each = lambda rows, names: parts.crossJoin(F.broadcast(s.createDataFrame(rows, names)))
    edges = each([(n, *w) for n, w in enumerate(WIRES)], "ord int, net string, source string, target string, bit_width int").withColumn("sig_class", F.lit("wire"))
    return edges, each(PLACED_PORTS, "endpoint string, kind string, side string, x int, y int, width int, parent string"), each(PLACED, "block string, x int, y int, width int, height int")


@_query(f"SELECT p_partkey AS module, v.net, v.way, v.line, v.points FROM part, (VALUES {_values(ROUTED)}) v(n, net, way, line, points)")
def schematic_routes(s, d):
    nets, lines = routes.routes(*_layout(s, d))
    points = F.array_join(F.transform("points", lambda p: F.concat_ws(",", p["x"], p["y"])), " ")
    return lines.join(graphs.apart(nets), ["module", "net"]).select("module", "net", "way", F.col("line").cast("int").alias("line"), points.alias("points"))


@_query("SELECT p_partkey AS module, v.block, v.x FROM part, (VALUES ('A', 60), ('A', 140), ('C', 220), ('C', 280), ('E', 360), ('E', 440)) v(block, x)")
def points_in_blocks(s, d):
    """Blocks at points along a level line through the middle of each of three."""
    _, _, blocks = _layout(s, d)
    places = s.createDataFrame([(x, y) for x, y in ((60, 200), (140, 250), (141, 200), (59, 150), (220, 300), (280, 350), (300, 300), (360, 310), (440, 330), (440, 331))], "x int, y int")
    points = _t(s, d, "part").select(F.col("p_partkey").alias("module")).crossJoin(F.broadcast(places))
    return routes.blocks_at(points, routes.boxes(blocks)).select("module", "block", "x")


# Nodes of three levels with label and region, and their order worked out by hand; the cross of a, c and d settles by what follows them.
LEVELS = [("a", 0, "b", "r1", 1), ("c", 0, "A", "r1", 0), ("d", 0, "z", "r0", 2), ("x", 1, "x", "r", 1), ("y", 1, "y", "r", 2), ("z", 1, "z", "r", 0), ("w", 2, "w", "r", 1), ("v", 2, "v", "r", 0)]
FOLLOWS = [("a", "x"), ("d", "y"), ("c", "z"), ("x", "w"), ("z", "v"), ("x", "gone"), ("x", "x")]


@_query(f"SELECT p_partkey AS module, v.node, v.level, CAST(v.place AS BIGINT) AS place FROM part, (VALUES {_values(LEVELS)}) v(n, node, level, label, region, place)")
def layers_in_order(s, d):
    """One graph for each part, as a module of its own."""
    parts = _t(s, d, "part").select(F.col("p_partkey").alias("module"))
    each = lambda rows, names: parts.crossJoin(F.broadcast(s.createDataFrame(rows, names)))
    return geometry.module_order(each([x[:4] for x in LEVELS], "node string, level int, label string, region string"), each(FOLLOWS, "src string, dst string"))


# The same nodes in the order of the view's instances: z stands over y only after a pass, so w and v change places in each.
AT_ONCE = [("c", 0, 0), ("a", 0, 1), ("d", 0, 2), ("x", 1, 0), ("z", 1, 1), ("y", 1, 2), ("w", 2, 0), ("v", 2, 1)]


@_query(f"SELECT p_partkey AS module, v.node, v.level, CAST(v.place AS BIGINT) AS place FROM part, (VALUES {_values(AT_ONCE)}) v(n, node, level, place)")
def instances_in_order(s, d):
    parts = _t(s, d, "part").select(F.col("p_partkey").alias("module"))
    each = lambda rows, names: parts.crossJoin(F.broadcast(s.createDataFrame(rows, names)))
    return geometry.instance_order(each([x[:3] for x in LEVELS], "node string, level int, label string"), each(FOLLOWS, "src string, dst string"))


def queries() -> dict:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in _Q.items() if sql}
