"""Routes, hits and metrics against plain loops over random layouts."""

import random

from netloom.operators import routes

EDGE = "module int, ord int, net string, source string, target string, sig_class string, bit_width int"
PORT = "module int, endpoint string, kind string, side string, x int, y int, width int, parent string"
BLOCK = "module int, block string, x int, y int, width int, height int"


def segments(line):
    return [(a, b) for a, b in zip(line, line[1:]) if a[0] == b[0] or a[1] == b[1]]


def inside(a, b, box):
    left, top, right, bottom = box
    if a[0] == b[0]:
        return left < a[0] < right and min(a[1], b[1]) < bottom and max(a[1], b[1]) > top
    return top < a[1] < bottom and min(a[0], b[0]) < right and max(a[0], b[0]) > left


def measured(lines, boxes):
    parts = [s for line in lines for s in segments(line)]
    level, upright = [s for s in parts if s[0][0] != s[1][0]], [s for s in parts if s[0][0] == s[1][0]]
    crossings = sum(min(a[0], b[0]) < c[0] < max(a[0], b[0]) and min(c[1], d[1]) < a[1] < max(c[1], d[1]) for a, b in level for c, d in upright)
    return crossings, sum(max(0, len(line) - 2) for line in lines), sum(inside(*s, box) for s in parts for box in boxes)


def layout(seed):
    draw, edges, ports, blocks = random.Random(seed), [], [], []
    for m in range(3):
        names = [f"b{k}" for k in range(7)]
        for k, b in enumerate(names):
            x, y = 150 + 260 * (k % 3), 150 + 220 * (k // 3) + draw.randrange(60)
            blocks.append((m, b, x, y, 120, 90))
            ports += [(m, f"{b}.{side}{p}", "instance", side, x + (-60 if side == "left" else 60), y - 30 + 20 * p, None, b) for side in ("left", "right") for p in range(4)]
        ports.append((m, "io", "module_io", "left", 10, 333, 30, None))
        for n in range(25):
            net = draw.choice(["clk", "bus", "w", "busy", "n"]) + str(draw.randrange(12))
            edges.append((m, n, net, draw.choice([f"{draw.choice(names)}.right{draw.randrange(4)}", "io"]), f"{draw.choice(names)}.left{draw.randrange(4)}", "wire", 8 if net[0] == "b" else None))
    return edges, ports, blocks


def test_metrics_by_plain_loops(spark):
    edges, ports, blocks = layout(3)
    e, p, b = spark.createDataFrame(edges, EDGE), spark.createDataFrame(ports, PORT), spark.createDataFrame(blocks, BLOCK)
    box = {m: [(x - w // 2, y - h // 2, x + w // 2, y + h // 2) for k, _, x, y, w, h in blocks if k == m] for m in range(3)}
    nets, lines = routes.routes(e, p, b)
    nets, lines = nets.cache(), lines.cache()
    for found in (lines, routes.plain_lines(e, p)):
        held = {m: [] for m in range(3)}
        for r in found.collect():
            held[r["module"]].append([(q["x"], q["y"]) for q in r["points"]])
        for cell in (40, 256):
            got = {r["module"]: (r["crossings"], r["bends"], r["overlaps"]) for r in routes.metrics(found, b, cell).collect()}
            assert got == {m: measured(held[m], box[m]) for m in range(3)}
    # nothing that is drawn runs through a block that its net doesn't connect, but for the stubs of named nets
    ends = {(m, q): parent or q for m, q, *_, parent in ports}
    own = {}
    for m, _, net, s, t, *_ in edges:
        own.setdefault((m, net), set()).update({ends[m, s], ends[m, t]})
    way = {(r["module"], r["net"]): r["way"] for r in nets.collect()}
    assert set(way) == set(own) and {"direct", "lane", "named"} <= set(way.values()) | {"direct"}
    place = {(m, k): (x - w // 2, y - h // 2, x + w // 2, y + h // 2) for m, k, x, y, w, h in blocks}
    for r in lines.collect():
        if way[r["module"], r["net"]] != "named":
            points = [(q["x"], q["y"]) for q in r["points"]]
            assert not any(inside(*s, q) for s in segments(points) for (m, k), q in place.items() if m == r["module"] and k not in own[m, r["net"]])
    lanes = [(r["module"], r["kind"], r["lane_y"]) for r in nets.where("way = 'lane' AND kind <> 'wire'").collect()]
    assert len(lanes) == len(set(lanes))
    assert {r["module"]: r["overlaps_reduced_by"] >= 0 for r in routes.improvement(e, lines, p, b).collect()} == dict.fromkeys(range(3), True)


def test_points_on_segments(spark):
    lines = spark.createDataFrame([(1, "n", 0, [{"x": 0, "y": 0}, {"x": 700, "y": 0}, {"x": 700, "y": 300}])], "module int, net string, line int, points array<struct<x:long,y:long>>")
    points = spark.createDataFrame([(1, x, y) for x, y in ((350, 5), (350, 7), (706, 250), (707, 250), (700, 0), (-6, -6))] + [(2, 350, 0)], "module int, x int, y int")
    got = sorted((r["x"], r["y"], r["place"]) for r in routes.segments_at(points, routes.segments(lines)).collect())
    assert got == [(-6, -6, 0), (350, 5, 0), (700, 0, 0), (700, 0, 1), (706, 250, 1)]


def test_order_within_modules(spark):
    from netloom.operators import geometry

    nodes = [(m, n, k, t, r) for m in (1, 2) for n, k, t, r in (("p", 0, "P", "b"), ("q", 0, "q", "a"), ("s", 1, "s", None), ("t", 1, None, "z"))]
    edges = [(1, "p", "s"), (1, "p", "s"), (2, "q", "t"), (2, "p", "s"), (3, "p", "s")]
    got = geometry.module_order(spark.createDataFrame(nodes, "module int, node string, level int, label string, region string"), spark.createDataFrame(edges, "module int, src string, dst string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "p", 0, 0), (1, "q", 0, 1), (1, "s", 1, 0), (1, "t", 1, 1), (2, "p", 0, 0), (2, "q", 0, 1), (2, "s", 1, 0), (2, "t", 1, 1)]
    none = spark.createDataFrame([], "module int, node string, level int, label string, region string")
    assert geometry.module_order(none, spark.createDataFrame(edges, "module int, src string, dst string")).count() == 0


def test_routes_and_metrics_send_no_table_to_all_tasks(spark, monkeypatch):
    edges, ports, blocks = layout(3)
    e, p, b = spark.createDataFrame(edges, EDGE), spark.createDataFrame(ports, PORT), spark.createDataFrame(blocks, BLOCK)
    plans, cut = [], routes.cut
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(routes, "cut", lambda df: plan(df) or cut(df))
    nets, lines = routes.routes(e, p, b)
    points = p.select("module", "x", "y")
    for df in (nets, lines, routes.improvement(e, lines, p, b), routes.blocks_at(points, routes.boxes(b)), routes.segments_at(points, routes.segments(lines))):
        plan(df)
    assert len(plans) == 9 and all("SortMergeJoin" in x and "Broadcast" not in x for x in plans if "Join" in x)
    assert sum("Join" in x for x in plans) >= 8
