"""Catalog, run-log, geometry and stream operators on small inputs of their own."""

from pyspark.sql import functions as F

from netloom.operators import design, geometry, graphs, runlogs
from netloom.sources import rtl
from netloom.streaming import events as streams

CHAIN = "module mid (input b, output c); assign c = b; endmodule\nmodule top (input a, output d); mid u (.b(a), .c(d)); ghost g (.x(a), .y()); endmodule"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def catalog(spark, text=CHAIN, path="a.v"):
    return design.catalog(rtl.modules(spark.createDataFrame([(path, text)], "path string, text string")))


def test_hops_and_trace(spark):
    tables = catalog(spark)
    hops = design.hops(tables).cache()
    assert rows(hops, "module", "target", "next_module", "source", "kind") == [("mid", "b", "top", "a", "port"), ("mid", "c", "mid", "b", "assign"), ("top", "d", "mid", "c", "instance")]
    found = graphs.reachable(design.hop_edges(hops), spark.createDataFrame([("top.d",)], "node string"))
    assert rows(found, "node", "depth") == [("mid.b", 2), ("mid.c", 1), ("top.a", 3), ("top.d", 0)]


def test_connectivity(spark):
    tables = catalog(spark)
    found = rows(design.connectivity(design.endpoints(tables)).where("module = 'top'"), "net", "src", "dst", "flow")
    assert found == [("a", "io:a", "instance:u", "directed"), ("d", "instance:u", "io:d", "directed")]
    tops = graphs.infer_tops(tables["modules"].select(F.col("module").alias("name"), F.lit(False).alias("is_testbench")), design.children(tables).withColumn("parent_is_testbench", F.lit(False)))
    assert rows(tops) == [("top",)]


def test_empty_catalog(spark):
    tables = catalog(spark, None)
    assert all(t.count() == 0 for t in tables.values())
    assert design.hops(tables).count() == design.endpoints(tables).count() == 0


def test_refresh(spark):
    old = catalog(spark)["modules"].select("path", "module")
    new = catalog(spark, "module mid2 (input b); endmodule module top (input a); endmodule")["modules"].select("path", "module")
    assert rows(design.changed_modules(old, new), "module", "change") == [("mid", "lost"), ("mid2", "added")]
    assert rows(design.refreshed(old, new), "module") == [("mid2",), ("top",)]


def test_run_logs(spark):
    logs = spark.createDataFrame([(1, "VCD info: FAIL\r\nPASS [t=5] adder: fine\n\nnote"), (2, "Test passed\nError @12 carry"), (3, "quiet passage"), (4, None)], "run int, text string")
    events = runlogs.events(runlogs.log_lines(logs, "run", "text")).cache()
    assert rows(events.where("verdict IS NOT NULL"), "run", "kind", "verdict", "label", "time") == [(1, "pass", "pass", "adder", 5), (2, "error", "fail", "ERROR", 12), (2, "pass", "pass", "PASSED", None)]
    runs = spark.createDataFrame([(1, 0, None), (2, 0, "match"), (3, 0, None), (4, 0, "match"), (5, 1, "match")], "run int, exit_code int, golden string")
    assert rows(runlogs.verdicts(events, runs), "run", "verdict") == [(1, "pass"), (2, "fail"), (3, "unknown"), (4, "pass"), (5, "fail")]


def test_golden(spark):
    files = spark.createDataFrame([("t/a.golden",), ("t/a.expected",), ("t/b.golden",)], "path string")
    benches = spark.createDataFrame([("t/a",), ("t/b",), ("t/c",)], "bench string")
    assert rows(runlogs.golden_files(files, benches)) == [("t/a", "t/a.expected"), ("t/b", "t/b.golden")]
    side = lambda x: spark.createDataFrame([(1, x)], "run int, text string")
    found = rows(runlogs.compared(side("a  \r\nb\n"), side("a\nc\nd")), "line_no", "same")
    assert found == [(0, True), (1, False), (2, False)]


def test_strong_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)], "src int, dst int")
    nodes = spark.createDataFrame([(n,) for n in range(1, 8)], "node int")
    assert rows(graphs.strong_components(edges, nodes)) == [(1, 3), (2, 3), (3, 3), (4, 5), (5, 5), (6, 6), (7, 7)]
    assert graphs.strong_components(edges.limit(0), nodes.limit(0)).count() == 0


def test_order_and_boxes(spark):
    nodes = spark.createDataFrame([("a", 0, "a"), ("b", 0, "b"), ("x", 1, "x"), ("y", 1, "y"), ("z", 1, "z")], "node string, level int, label string")
    edges = spark.createDataFrame([("b", "x"), ("a", "y")], "src string, dst string")
    placed = geometry.layer_order(nodes, edges)
    assert rows(placed.where("level = 1"), "node", "place") == [("x", 1), ("y", 0), ("z", 2)]
    ports = spark.createDataFrame([("x", "left")] * 3, "node string, side string")
    assert rows(geometry.boxes(placed, ports).where("node = 'x'"), "x", "y", "width", "height") == [(300, 160, 220, 126)]


def test_upserts_go_on_where_they_stopped(spark, tmp_path):
    def put(n, *records):
        spark.createDataFrame(records, "path string, v int").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))

    def go():
        source = spark.readStream.schema("path string, v int").parquet(str(tmp_path / "in" / "part=*"))
        streams.upserted(source, str(tmp_path / "out"), lambda b: b.withColumn("v", F.col("v") * 10))
        return rows(streams.latest(spark, str(tmp_path / "out")), "path", "v")

    put(0, ("a", 1), ("a", 2), ("b", 3))
    assert go() == [("a", 10), ("a", 20), ("b", 30)]
    put(1, ("a", 9))
    assert go() == [("a", 90), ("b", 30)]


def test_command_line(spark, tmp_path, capsys):
    from netloom.__main__ import main

    (tmp_path / "in").mkdir()
    assert main(["scan", str(tmp_path / "in")]) == 2
    (tmp_path / "in" / "a.v").write_text(CHAIN)
    assert main(["scan", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--graph"]) == 0
    said = capsys.readouterr().out
    assert "1 files, 2 modules, 0 diagnostics\ntops: top\ntop\n  ghost\n  mid\n" in said
    assert spark.read.json(str(tmp_path / "out" / "graph")).count() == 2


def test_connectivity_of_all_pairs(spark):
    ends = spark.createDataFrame([("m", "n", x, "p", "sink", 1, False) for x in "cab"] + [("m", "k", "a", "p", "source", 2, True), ("m", "k", "b", "p", "sink", 2, True)], "module string, net string, node string, port string, role string, bit_width int, is_bus boolean")
    assert rows(design.connectivity(ends), "net", "src", "dst", "flow") == [("k", "a", "b", "directed"), ("n", "a", "b", "unknown"), ("n", "a", "c", "unknown")]
    assert rows(design.connectivity(ends, all_pairs=True), "net", "src", "dst", "flow") == [("k", "a", "b", "directed"), ("n", "a", "b", "unknown"), ("n", "a", "c", "unknown"), ("n", "b", "c", "unknown")]
