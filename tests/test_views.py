"""Views of a catalog, project files, lint and text forms on small inputs."""

import pytest
from pyspark.sql import functions as F

from netloom.functions import scalars
from netloom.operators import design, lint, views
from netloom.project import Design, Waveform
from netloom.sources import files as project_files
from netloom.sources import rtl

CHAIN = "module mid (input b, output [3:0] c, input e); assign c = b; endmodule\nmodule top (input a, output [3:0] d); mid u (.b(a), .c(d), .e()); mid v (.b(a)); ghost g (.x(a), .y()); always @(a) t <= t; reg t; endmodule\n"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    return {k: t.cache() for k, t in design.catalog(rtl.modules(spark.createDataFrame([("a.v", CHAIN)], "path string, text string"))).items()}


def test_net_graph_and_ports(tables):
    ends = design.endpoints(tables).where("module = 'top'").cache()
    found = rows(views.net_graph(ends).where("net IN ('a', 'd', 't')"), "src", "dst", "flow")
    assert found == [
        ("always:3", "net:t", "directed"), ("instance:u", "net:d", "directed"), ("io:a", "net:a", "directed"), ("net:a", "always:3", "directed"), ("net:a", "instance:g", "unknown"),
        ("net:a", "instance:u", "directed"), ("net:a", "instance:v", "directed"), ("net:d", "io:d", "directed"), ("net:t", "always:3", "directed"),
    ]
    seen = {r[0] for r in rows(views.port_view(ends), "node")}
    assert {"instance_port:u.b", "process_port:3:inout:t", "process_port:3:input:a", "io:a"} <= seen


def test_aggregated(spark):
    edges = spark.createDataFrame([("m", "n1", "a", "b", "directed", 8, True), ("m", "n0", "a", "b", "directed", 1, False), ("m", "n2", "a", "c", "directed", 1, False)], "module string, net string, src string, dst string, flow string, bit_width int, is_bus boolean")
    found = rows(views.aggregated(edges), "dst", "nets", "bus_nets", "wire_nets", "bit_width", "net_count", "sig_class", "net")
    assert found == [("b", ["n0", "n1"], ["n1"], ["n0"], 8, 2, "mixed", None), ("c", ["n2"], [], ["n2"], 1, 1, "wire", "n2")]


def test_missing_and_unresolved(tables):
    assert rows(views.missing_pins(tables), "instance", "child_port", "open") == [("u", "e", True), ("v", "c", False), ("v", "e", False)]
    assert rows(views.unresolved(tables)) == [("top", "a", "g", "ghost")]


def test_tree_and_hierarchy_graph(spark, tables):
    tree = views.instance_tree(tables, spark.createDataFrame([("top",)], "node string"))
    assert rows(tree, "path", "depth", "cycle", "resolved") == [("top", 0, False, True), ("top/g:ghost", 1, False, False), ("top/u:mid", 1, False, True), ("top/v:mid", 1, False, True)]
    nodes, edges = views.hierarchy_graph(tables, tree)
    ids = [r[0] for r in rows(nodes, "id")]
    assert len(ids) == len(set(ids))
    assert {"module:top", "instance:top/u", "port:top:a", "port:instance:top/u:b", "net:top:a", "net:top:t", "net:top:__open__:u.e", "module:top/u:mid", "net:top/u:mid:b"} <= set(ids)
    found = rows(edges)
    assert ("net:top:a", "port:instance:top/u:b", "signal") in found and ("instance:top/u", "module:top/u:mid", "hierarchy") in found
    assert {x for e in found for x in e[:2]} <= set(ids)


def test_cycles_end(spark):
    loop = design.catalog(rtl.modules(spark.createDataFrame([("a.v", "module x (input a); y u (.a(a)); endmodule module y (input a); x v (.a(a)); endmodule")], "path string, text string")))
    tree = views.instance_tree(loop, spark.createDataFrame([("x",)], "node string"))
    assert rows(tree, "path", "cycle") == [("x", False), ("x/u:y", False), ("x/u:y/v:x", True)]


def test_trace(spark, tables):
    hops = design.hops(tables).cache()
    assert rows(views.trace(hops, "top", "d"), "direction", "id", "next_module", "next_signal", "kind") == [("fanin", 0, "mid", "c", "instance"), ("fanout", 0, None, None, "dead_end")]
    both = rows(views.trace(hops, "mid", " b "), "direction", "id", "next_module", "next_signal", "kind")
    assert both == [("fanin", 0, "top", "a", "port"), ("fanout", 0, "mid", "c", "assign")]


def test_new_instance(spark, tables):
    files = spark.createDataFrame([("a.v", CHAIN)], "path string, text string")
    text = views.with_instance(files, tables, "top", "mid").first()["text"]
    again = rtl.instances(rtl.modules(spark.createDataFrame([("a.v", text)], "path string, text string")))
    assert rows(again.where("module = 'top'"), "name", "child") == [("g", "ghost"), ("mid_inst", "mid"), ("u", "mid"), ("v", "mid")]
    with pytest.raises(ValueError):
        views.with_instance(files, tables, "top", "ghost")
    with pytest.raises(ValueError):
        views.new_module(tables, "mid")
    assert rtl.modules(spark.createDataFrame([("n.v", views.new_module(tables, "fresh"))], "path string, text string")).first()["module"] == "fresh"


def test_lint(spark):
    texts = ["module m (input a); // begin (\n  always begin\n    x = \"(\";\n  end\nendmodule", "module m;\n  begin (a ];\nendmodule end", None, "", "/* open begin"]
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    assert sorted(map(tuple, lint.lint(files).collect())) == [("1", 2, 3, "'begin' is not closed"), ("1", 2, 9, "'(' is not closed"), ("1", 2, 12, "']' closes nothing"), ("1", 3, 11, "'end' closes nothing")]


def test_files(spark):
    files = spark.createDataFrame([("p/testbenches/a.v", "x"), ("p/cpu_tb.sv", "x"), ("p/cpu.v", "a\r\n$finish;"), ("p/attest.v", "b(a)"), ("p/n.v", None)], "path string, text string")
    relative = F.regexp_replace("path", "^p/", "")
    assert rows(project_files.test_benches(files, relative), "relative", "source", "size") == [("cpu.v", "discovered", 11), ("cpu_tb.sv", "discovered", 1), ("testbenches/a.v", "managed", 1)]
    assert [tuple(r) for r in project_files.search(files, "a$|x").collect()] == [("p/cpu.v", 1, "a"), ("p/testbenches/a.v", 1, "x"), ("p/cpu_tb.sv", 1, "x")]
    assert rows(project_files.search(files, "b(", limit=None)) == [("p/attest.v", 1, "b(a)")]


def test_version_control(spark, tmp_path):
    import subprocess

    git = lambda *w: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=N", "-c", "user.email=e@x", *w], check=True, capture_output=True)
    git("init", "-q")
    git("commit", "-q", "--allow-empty", "-m", "first | one")
    git("commit", "-q", "--allow-empty", "-m", "second")
    (tmp_path / "new.v").write_text("x")
    assert rows(project_files.history(spark, str(tmp_path)), "ord", "author_name", "subject") == [(0, "N", "second"), (1, "N", "first | one")]
    assert rows(project_files.status(spark, str(tmp_path))) == [("??", "new.v")]


def test_text_forms(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    value = lambda bits, width, radix: one(scalars.bus_value(F.lit(bits), F.lit(width), radix))
    assert [value("10110", 5, r) for r in ("bin", "hex", "dec", "sdec")] == ["b10110", "h16", "22", "-10"]
    assert [value("101", 5, r) for r in ("bin", "hex", "dec", "sdec")] == ["b00101", "h05", "5", "5"]
    assert [value("1x0z", 4, "hex"), value("1z", 2, "bin"), value("1.5", 64, "dec"), value("1" * 70, 70, "hex"), value("1" * 70, 70, "sdec")] == ["x", "zz", "1.5", "h3" + "F" * 17, "-1"]
    assert [one(scalars.time_text(F.lit(t))) for t in (999, 1500, 2_500_000, 3_000_000_000)] == ["999", "1.50k", "2.50M", "3.00G"]
    assert [one(scalars.tick_step(F.lit(s))) for s in (100, 800, 0)] == [20.0, 100.0, None]
    names = spark.createDataFrame([(n,) for n in ("a10", "A2", "a1b", "a01a")], "n string")
    assert [r[0] for r in names.orderBy(scalars.natural_key(F.col("n"))).collect()] == ["a01a", "a1b", "A2", "a10"]
    assert one(scalars.shortened(F.lit("abcdefghij"), 4)) == "ab\n…[6 chars truncated]…\nij"
    assert one(scalars.is_control_name(F.lit("Sys_CLK"))) and not one(scalars.is_control_name(F.lit("data")))


def test_project(spark, tmp_path):
    root = tmp_path / "src"
    (root / ".hidden").mkdir(parents=True)
    (root / "src.v").write_text(CHAIN)
    (root / ".hidden" / "b.v").write_text("module hid (input a); endmodule")
    project = Design.load(spark, str(root))
    assert rows(project.tops()) == [("top",)] and rows(project.unused()) == [("top",)]
    assert rows(project.hierarchy(), "path") == [("top",), ("top/g:ghost",), ("top/u:mid",), ("top/v:mid",)]
    assert rows(project.connectivity("mid", aggregate=True), "src", "dst", "sig_class") == [("assign:0:c", "io:c", "bus"), ("io:b", "assign:0:c", "wire")]
    assert rows(project.connectivity("mid", "detailed", ports=True).where("net = 'b'"), "src", "dst") == [("io:b", "net:b"), ("net:b", "assign:0:c")]
    assert rows(project.reach("top", "d"), "node") == [("mid.b",), ("mid.c",), ("top.a",), ("top.d",)]
    assert project.lint().count() == project.diagnostics().count() == project.test_benches().count() == 0
    assert project.search("assign").count() == 1 and set(project.module("mid")) >= {"ports", "pins"}
    for wrong in (lambda: project.connectivity("no"), lambda: project.connectivity("mid", "other"), lambda: project.trace("no", "x")):
        with pytest.raises(ValueError):
            wrong()


def test_waveform(spark, tmp_path):
    (tmp_path / "a.vcd").write_text("$scope module t $end\n$var wire 1 ! clk $end\n$var wire 4 # d $end\n$upscope $end\n$enddefinitions $end\n#0\n0!\n#10\n1!\nb101 #\n#20\n0!\n")
    wave = Waveform(spark, str(tmp_path / "a.vcd"))
    assert sorted(map(tuple, wave.snapshot([5, 15]).collect())) == [("t.clk", 5, "0"), ("t.clk", 15, "1"), ("t.d", 15, "101")]
    assert [tuple(r) for r in wave.window(15, 5, ["CLK"]).collect()] == [(10, "t.clk", "1"), (20, "t.clk", "0")]


def test_deep_hierarchies(spark):
    """Seventy levels: nothing is left out, and a module on its own path ends it."""
    from netloom.operators import graphs, views

    links = [(f"m{i}", f"m{i + 1}") for i in range(70)]
    tree = graphs.hierarchy(spark.createDataFrame([*links, ("m70", "m69")], "parent string, child string"), spark.createDataFrame([("m0",)], "node string")).collect()
    assert max(r["depth"] for r in tree) == 71 and [r["node"] for r in tree if r["cycle"]] == ["m69"]
    tables = {"modules": spark.createDataFrame([(f"m{i}",) for i in range(71)], "module string"), "instances": spark.createDataFrame([(a, "u", b) for a, b in links], "module string, name string, child string")}
    places = views.instance_tree(tables, spark.createDataFrame([("m0",)], "node string"))
    assert places.count() == 71 and places.where("resolved").count() == 71
