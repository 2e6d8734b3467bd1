from pyspark.sql import functions as F

from netloom.operators import design, geometry, graphs, schematic

NODE = "id string, module long, kind string, parent string, direction string, ord int"
EDGE = "id string, module long, src string, dst string, net string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_empty_tables(spark):
    nodes, edges = spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)
    starts = spark.createDataFrame([], "node string")
    for found in (schematic.instance_levels(nodes, edges), schematic.layout_roots(nodes, edges), schematic.edge_routing(nodes, edges), schematic.unconnected(nodes, edges), schematic.neighbourhood(nodes, edges, starts), schematic.port_trace(nodes, edges, starts)):
        assert found.isEmpty()
    routes = spark.createDataFrame([], "route long, points array<struct<x:long,y:long>>")
    blocks = spark.createDataFrame([], "block long, x1 long, y1 long, x2 long, y2 long")
    assert rows(geometry.route_metrics(routes, blocks), "crossings", "bends", "overlaps") == [(0, 0, 0)]


def test_first_node_is_the_root_where_all_are_fed(spark):
    nodes = spark.createDataFrame([("b", 1, "instance", None, None, 0), ("a", 1, "instance", None, None, 1), ("p", 1, "instance_port", "a", "input", 2)], NODE)
    edges = spark.createDataFrame([("e", 1, "a", "b", "n"), ("f", 1, "b", "a", None), ("g", 1, "a", "a", "s")], EDGE)
    assert rows(schematic.layout_roots(nodes, edges), "id") == [("b",)]
    assert rows(schematic.instance_levels(nodes, edges), "node", "level") == [("a", 1), ("b", 2)]
    assert rows(schematic.same_net(edges, edges), "start", "id") == [("e", "e"), ("f", "f"), ("g", "g")]


def test_partial_levels_stop_at_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (5, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 6)], "node long")
    assert rows(graphs.partial_levels(edges, nodes), "node", "level", "resolved") == [(1, 0, True), (2, 1, False), (3, 0, False), (4, 0, False), (5, 0, True)]


def test_a_trace_does_not_cross_to_ports_in_both_directions(spark):
    nodes = spark.createDataFrame([("i", 1, "instance", None, None, 0), ("i.a", 1, "instance_port", "i", "input", 1), ("i.b", 1, "instance_port", "i", "inout", 2), ("i.c", 1, "instance_port", "i", None, 3)], NODE)
    edges = spark.createDataFrame([("e", 1, "x", "i.a", "n"), ("f", 1, "i.b", "y", "m"), ("g", 1, "i.a", "z", "k")], EDGE)
    starts = spark.createDataFrame([("x",)], "node string")
    assert rows(schematic.port_trace(nodes, edges, starts), "port", "depth", "crossed") == [("i.a", 0, False), ("z", 1, False)]


def test_ports_of_a_crowded_side_hide_plain_labels(spark):
    blocks = spark.createDataFrame([("u", 0, 0, 100, 56)], "node string, x long, y long, width long, height long")
    ports = spark.createDataFrame([(f"u.{k}", "u", name, "input", k == 3) for k, name in enumerate(["p", "CLK", "q", "bus", *[f"w{j}" for j in range(8)]])], "id string, parent string, name string, direction string, is_bus boolean")
    found = {r["id"]: (r["y"], r["label_visible"]) for r in schematic.port_places(blocks, ports).collect()}
    assert found["u.1"] == (0, True) and found["u.3"] == (20, True) and found["u.0"] == (40, False) and sum(v for _, v in found.values()) == 2


def test_a_segment_and_a_wide_block_meet_once(spark):
    routes = spark.createDataFrame([(1, [(0, 10), (500, 10)]), (2, [(250, 0), (250, 50)]), (3, [(5, 5)]), (4, [(0, 0), (7, 9)])], "route long, points array<struct<x:long,y:long>>")
    blocks = spark.createDataFrame([(1, 100, 0, 400, 20), (2, 0, 10, 500, 30)], "block long, x1 long, y1 long, x2 long, y2 long")
    assert rows(geometry.route_metrics(routes, blocks), "crossings", "bends", "overlaps") == [(1, 0, 3)]


def test_metrics_of_routes_are_counted_without_pairs(spark):
    import random

    draw = random.Random(5)
    ends = lambda: draw.choice([draw.randrange(-90, 90), draw.choice([-64, -1, 0, 63, 64, 65])])
    lines, boxes = [], []
    for k in range(150):
        x, y = ends(), ends()
        lines.append((k, [(x, y), (u := draw.choice([x, ends()]), y), (u, ends()), (draw.choice([u, ends()]), ends())][: draw.randrange(5)] if k else None))
        boxes.append((k, ends(), ends(), ends(), ends()))
        if k % 2:
            boxes[-1] = (k, *map(min, zip(boxes[-1][1:3], boxes[-1][3:])), *map(max, zip(boxes[-1][1:3], boxes[-1][3:])))
    lines += [(k, [(5, 9), (400, 9), (400, -300)]) for k in range(200)] + [(k, [(200, -9), (200, 99), None]) for k in range(300)]
    boxes += [(1, 0, 0, None, 5), (2, 199, 5, 202, 12)]
    parts = [(a, b) for _, line in lines for a, b in zip(line or [], (line or [])[1:]) if a and b]
    flat = [(a[1], *sorted((a[0], b[0]))) for a, b in parts if a[1] == b[1] and a[0] != b[0]]
    tall = [(a[0], *sorted((a[1], b[1]))) for a, b in parts if a[0] == b[0]]
    crossed = sum(a < x < b and c < y < d for y, a, b in flat for x, c, d in tall)
    known = [box[1:] for box in boxes if None not in box]
    over = sum(t < y < b and x1 < r and x2 > le for y, x1, x2 in flat for le, t, r, b in known) + sum(le < x < r and y1 < b and y2 > t for x, y1, y2 in tall for le, t, r, b in known)
    bends = sum(max(0, len(line or []) - 2) for _, line in lines)
    for kind in ("long", "int", "double"):
        routes = spark.createDataFrame([(k, line and [p and tuple(map(float if kind == "double" else int, p)) for p in line]) for k, line in lines], f"route long, points array<struct<x:{kind},y:{kind}>>")
        blocks = spark.createDataFrame(boxes, "block long, x1 int, y1 int, x2 int, y2 int")
        assert rows(geometry.route_metrics(routes, blocks), "crossings", "bends", "overlaps") == [(crossed, bends, over)]
    routes = routes.withColumn("points", F.col("points").cast("array<struct<x:long,y:long>>"))
    plan = geometry.route_metrics(routes, blocks.where("x1 < x2 AND y1 < y2"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate(keys=[cx" in plan


def test_controls_of_blocks_without_statements_and_of_labelled_ones():
    from netloom.sources.verilog import procedure_of

    assert procedure_of("always") == ([], []) and procedure_of("always @(*) ;") == ([], [])
    assert procedure_of("always @(*) begin end") == ([], [])
    assert procedure_of("always_comb begin : m for (i = 0; i < 4; i = i + 1) begin if (a) b = c; end if (x) y = z; end : m")[1] == ["if (x)"]


def test_no_join_sends_exploded_rows_through_the_driver(spark, capsys):
    parts = spark.range(1000).select(F.col("id").alias("module"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("n")).withColumn("id", F.concat_ws(".", "module", "n"))
    nodes = parts.select("id", "module", F.lit("instance").alias("kind"), F.lit(None).cast("string").alias("parent"), F.lit("input").alias("direction"), F.col("n").alias("ord"))
    edges = parts.select(F.concat_ws("-", "id").alias("id"), "module", F.col("id").alias("src"), F.concat_ws(".", "module", F.col("n") + 1).alias("dst"), F.lit("w").alias("net"))
    ends = parts.select("module", F.lit("n").alias("net"), F.col("id").alias("node"), F.col("id").alias("port"), F.when(F.col("n") > 20, "sink").otherwise("source").alias("role"), F.lit(1).alias("bit_width"), F.lit(False).alias("is_bus"))
    for df in (schematic.layout_roots(nodes, edges), schematic.with_blocks(nodes, edges), schematic.neighbourhood(nodes, edges, nodes.select(F.col("id").alias("node"))), schematic.same_net(edges, edges), design.connectivity(ends)):
        df.explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_crossings_and_overlaps_meet_once_in_square_cells(spark, capsys):
    import random

    random.seed(5)
    n = lambda: random.randint(-300, 300)
    level = [(k, n(), *sorted((n(), n()))) for k in range(60)]
    upright = [(k, n(), *sorted((n(), n()))) for k in range(60, 120)]
    blocks = [(k, *[v for pair in zip(sorted((n(), n())), sorted((n(), n()))) for v in pair]) for k in range(40)]
    lv, up, bl = spark.createDataFrame(level, "h int, y int, x1 int, x2 int"), spark.createDataFrame(upright, "v int, x int, y1 int, y2 int"), spark.createDataFrame(blocks, "block int, x1 int, y1 int, x2 int, y2 int")
    assert rows(geometry.crossings(lv, up), "h", "v") == sorted((h, v) for h, y, a, b in level for v, x, c, d in upright if a < x < b and c < y < d)
    flat = [(h, k) for h, y, a, b in level for k, x1, y1, x2, y2 in blocks if y1 < y < y2 and a < x2 and b > x1]
    tall = [(v, k) for v, x, a, b in upright for k, x1, y1, x2, y2 in blocks if x1 < x < x2 and a < y2 and b > y1]
    assert rows(geometry.overlaps(lv, up, bl), "segment", "block") == sorted(flat + tall)
    geometry.crossings(lv, up).explain()
    assert "row#" in capsys.readouterr().out
