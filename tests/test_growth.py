"""Steps that must not gather a growing table in one place."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from netloom.operators import design, graphs, runlogs, schematic, traces, within
from netloom.plans import bridge, grammar, schematics
from netloom.sources import rtl, verilog


def test_modules_are_dealt_to_a_fixed_number_of_tasks(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("module"), "id")
    found = within.by_module(rows, lambda mine: [(len(mine),)], "n int")
    assert found.rdd.getNumPartitions() == graphs.tasks(spark)
    assert sorted(r["n"] for r in found.collect()) == [14] * 5 + [15] * 2


def test_large_rounds_send_nothing_to_all_tasks(spark, capsys, monkeypatch):
    nodes, edges = spark.range(8).select(F.col("id").alias("node")), spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3), (5, 4)], "src long, dst long")
    want = [(0, 0), (1, 1), (2, 1), (3, 2), (4, 1), (5, 0), (6, 0), (7, 0)]
    assert sorted(map(tuple, graphs.layers(edges, nodes).collect())) == want
    monkeypatch.setattr(graphs, "FEW", 3)
    assert sorted(map(tuple, graphs.layers(edges, nodes).collect())) == want
    edges.join(graphs.sides(nodes, edges)(nodes.withColumnRenamed("node", "src")), "src").explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_edges_and_golden_files_keep_their_partitions(spark, tmp_path, capsys):
    spark.range(20).select((F.col("id") % 4).alias("l_orderkey"), F.col("id").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit("R").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
    bridge.queries()["aggregate_edges"](spark, str(tmp_path)).explain()
    assert capsys.readouterr().out.count("REPARTITION_BY_NUM") == 3
    runlogs.golden_files(spark.createDataFrame([("a.golden",)], "path string"), spark.createDataFrame([("a",)], "bench string")).explain()
    assert capsys.readouterr().out.count("REPARTITION_BY_NUM") == 2


def test_diffs_are_handed_over_in_pieces(spark):
    lines = "\n".join(map(str, range(runlogs.PIECE + 10)))
    want = spark.createDataFrame([(k, lines) for k in range(3)] + [(3, "a")], "run int, text string")
    got = spark.createDataFrame([(3, "a"), (2, lines + "\nmore")], "run int, text string")
    found = {r["run"]: (r["matched"], r["n"]) for r in runlogs.golden_diffs(got, want, most=None).select("run", "matched", F.size("diff").alias("n")).collect()}
    assert found == {0: (False, runlogs.PIECE + 13), 1: (False, runlogs.PIECE + 13), 2: (False, 7), 3: (True, 0)}
    udf = runlogs.golden_diffs(got, want)._jdf.queryExecution().toString()
    assert "MapInArrow" in udf and "ArrowEvalPython" not in udf


def test_files_are_parsed_once_and_leave_python_by_columns(spark):
    text = "module m (input [1:0] a, output y);\n  wire p = a;\n  assign y = p, z = ~p;\n  u i0 (.x(a), .y()), i1 ();\n  always @(posedge a) y <= p;\nendmodule"
    mods = rtl.modules(spark.createDataFrame([("f.v", text), ("g.v", "module e; endmodule")], "path string, text string"))
    assert rtl.assigns(mods)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = [{"path": "f.v", "mod_ord": n, **m} for t in (text, "module e; endmodule") for n, m in enumerate(verilog.parse(t)["modules"])]
    made = to_arrow_schema(mods.schema)
    assert rtl._batch(found, made).equals(pa.RecordBatch.from_pylist(found, made))
    assert sorted(tuple(r) for r in rtl.assigns(mods).select("idx", "target", "expression", "pos").collect()) == [(0, "p", "a", 0), (1, "y", "p", 0), (1, "z", "~p", 1)]
    assert sorted(r[0] for r in rtl.assigns(mods, decl_assigns=False).select("target").collect()) == ["y", "z"]


def test_rounds_of_a_trace_carry_no_texts(spark, monkeypatch):
    text = "module m (input a, output y); wire p = a; assign y = p; endmodule"
    tables, kept, cut = design.catalog(rtl.modules(spark.createDataFrame([("m.v", text)], "path string, text string"))), [], traces.cut
    monkeypatch.setattr(traces, "cut", lambda df: kept.append(df.schema.simpleString()) or cut(df))
    found = traces.trace(tables, spark.createDataFrame([("m", "y")], "module string, signal string"))
    assert "detail:" in kept[0] and len(kept) > 3 and not any("detail:" in k for k in kept[1:])
    rows = found.where("direction = 'fanin' AND chain = 0").orderBy("pos").select("signal", "kind", "detail").collect()
    assert [tuple(r) for r in rows] == [("y", "assign", "y = p"), ("p", "assign", "p = a"), ("a", "dead_end", "No fanin connections found")]


def test_routing_finds_the_blocks_of_edges_once(spark, monkeypatch):
    nodes = spark.createDataFrame([("i", 1, "instance", None, None), ("j", 1, "instance", None, None)], "id string, module int, kind string, parent string, direction string")
    edges = spark.createDataFrame([("e", 1, "i", "j", "n")], "id string, module int, src string, dst string, net string")
    calls, find = [], schematic.with_blocks
    monkeypatch.setattr(schematic, "with_blocks", lambda *a: calls.append(1) or find(*a))
    assert [tuple(r) for r in schematic.edge_routing(nodes, edges).select("id", "mode", "reason").collect()] == [("e", "routed", "single")]
    assert len(calls) == 1


def _circuit(spark):
    nodes = spark.createDataFrame([("i", 1, "instance", None, None, 0), ("j", 1, "instance", None, None, 1), ("ii", 1, "instance_port", "i", "input", 2), ("io", 1, "instance_port", "i", "output", 3), ("ji", 1, "instance_port", "j", "Input", 4), ("in", 1, "module_io", None, "input", 5)], "id string, module int, kind string, parent string, direction string, ord int")
    return nodes, spark.createDataFrame([("e", 1, "in", "ii", "n"), ("f", 1, "io", "ji", "m")], "id string, module int, src string, dst string, net string")


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_circuits_are_dealt_to_tasks_before_their_rows_are_made(spark, tmp_path):
    spark.range(1, 5).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert schematics._nodes(spark, str(tmp_path)).rdd.getNumPartitions() == schematics._edges(spark, str(tmp_path)).rdd.getNumPartitions() == rtl.tasks(spark)


def test_rounds_of_a_port_trace_dont_make_the_circuit_again(spark, monkeypatch):
    nodes, edges = _circuit(spark)
    made, cut = [], schematic.cut
    monkeypatch.setattr(schematic, "cut", lambda df: made.append("LogicalRDD" in _plan(df)) or cut(df))
    down = schematic.port_trace(nodes, edges, spark.createDataFrame([("in",)], "node string"))
    assert sorted(map(tuple, down.collect())) == [("in", "ii", 0, False), ("in", "io", 0, True), ("in", "ji", 1, False)]
    assert made[:3] == [True] * 3 and len(made) > 5 and not any(made[3:])


def test_levels_and_roots_join_a_circuit_once(spark, monkeypatch):
    nodes, edges = _circuit(spark)
    given, levels = [], within.settled_levels
    monkeypatch.setattr(within, "settled_levels", lambda n, e: given.append(_plan(e)) or levels(n, e))
    assert sorted(map(tuple, schematic.instance_levels(nodes, edges).collect())) == [("i", 0), ("j", 1)]
    assert "Join" not in given[0]
    roots = schematic.layout_roots(nodes, edges)
    assert [tuple(r) for r in roots.collect()] == [(1, "in")] and _plan(roots).count("Join") == 1


def test_items_of_other_kinds_stay_in_python_and_keep_their_places(spark):
    text = "module m (input a);\n  wire p = a;\n  and g (n, a, p);\n  u i0 (.x(a)), i1 ();\n  always @(posedge a) n <= p;\nendmodule"
    files = spark.createDataFrame([("f.v", text), ("g.v", "module e; endmodule"), ("h.v", "module h; assign y = 1; endmodule")], "path string, text string")
    every, few = rtl.modules(files), rtl.modules(files, ["gate", "instance"])
    assert sorted(tuple(i and i["kind"] for i in r["items"]) for r in few.select("items").collect()) == [(), (None,), (None, "gate", "instance", None)]
    for table in (rtl.gates, rtl.instances):
        assert sorted(map(str, table(few).collect())) == sorted(map(str, table(every).collect())) != []
    assert rtl.ports(few).collect() == rtl.ports(every).collect()


def test_connectivity_finds_the_ends_of_nets_once(spark):
    tables = design.catalog(rtl.modules(spark.createDataFrame([("m.v", "module m (input a, output y); assign y = a; endmodule")], "path string, text string")))
    found = design.connectivity(design.endpoints(tables))
    assert _plan(found).count("Join") == 3
    assert sorted(map(tuple, found.select("net", "src", "dst", "flow").collect())) == [("a", "io:a", "assign:0:y", "directed"), ("y", "assign:0:y", "io:y", "directed")]


def test_items_that_are_not_wanted_are_read_but_not_made(monkeypatch):
    parts = ["wire p = a, q;", "and (n, a, p), g (m, a);", "u i0 (.x(a), .y(f(b))), (c, );", "assign p = a, {q, r} = {b, c};", "always @(posedge a) if (b) n <= p; else n <= q;"]
    broken = ["u i (.a(b);", "assign = 3;", "u i (.1(a));", "wire w =;", "or (a, b", "end", "always begin a = 1;", ") ]"]
    texts = [f"module m (input a);\n{x}\n{b}\n{y}\nendmodule\n" for x in parts for b in broken for y in parts]
    texts.append(f"module m; always @* {'if (a) ' * 1500}b = 1; and (a, b, c); endmodule")
    found, calls, procedure = [verilog.parse(t) for t in texts], [], verilog.procedure_of
    monkeypatch.setattr(verilog, "procedure_of", lambda text: calls.append(len(text)) or procedure(text))
    for kinds in (("gate",), ("instance",), ("assign", "declaration"), ()):
        for t, every in zip(texts, found):
            mods = [m | {"items": [i if i["kind"] in kinds else None for i in m["items"]]} for m in every["modules"]]
            assert verilog.parse(t, kinds) == {"modules": mods, "lost": every["lost"]}
    assert calls == [len(texts[-1].split("and")[0].strip()) - len("module m; ")] * 4  # only what may be nested too deeply for its end to be known


def test_texts_of_parts_are_made_once_and_by_all_tasks(spark, tmp_path):
    spark.range(1, 5).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = grammar._files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == rtl.tasks(spark)
    plan = rtl.modules(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("wire last") == 1 and "Filter" not in plan
    nothing = spark.createDataFrame([("a.v", None), ("b.v", ""), ("c.v", "module c; endmodule")], "path string, text string")
    assert [r["module"] for r in rtl.modules(nothing).collect()] == ["c"]
