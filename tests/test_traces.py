"""Traces on small projects, and their chains against a plain recursive walk."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import design, traces
from netloom.sources import rtl

TOP = """module top(input wire clk, input wire rst_n, input wire src, output reg sink);
  wire branch, inner_out;
  assign branch = src;
  child u_child (.in_sig(branch), .out_sig(inner_out));
  always @(posedge clk or negedge rst_n) begin
    if (!rst_n) sink <= 1'b0;
    else sink <= inner_out;
  end
endmodule
"""
CHILD = "module child(input wire in_sig, output wire out_sig);\n  assign out_sig = in_sig;\nendmodule\n"


def catalog(spark, *texts):
    return design.catalog(rtl.modules(spark.createDataFrame([(f"f{k}.v", t) for k, t in enumerate(texts)], "path string, text string")))


def traced(spark, tables, module, signal, most=500):
    return traces.trace(tables, spark.createDataFrame([(module, signal)], "module string, signal string"), most).collect()


def chains(rows, direction):
    out = {}
    for r in sorted((r for r in rows if r["chain"] is not None and r["direction"] == direction), key=lambda r: (r["chain"], r["pos"])):
        out.setdefault(r["chain"], []).append(r)
    return list(out.values())


def test_a_chain_crosses_modules_and_says_where(spark):
    tables = catalog(spark, TOP, CHILD)
    rows = traced(spark, tables, "top", " src ")
    first = chains(rows, "fanout")[0]
    assert [(h["kind"], h["detail"], h["line"], h["path"]) for h in first] == [
        ("assign", "branch = src", 3, "f0.v"), ("instance_pin_in", "to child.in_sig", 4, "f0.v"), ("assign", "out_sig = in_sig", 2, "f1.v"),
        ("module_port_out", "↑ top.inner_out", 4, "f0.v"), ("always", "sink <= inner_out", 7, "f0.v"), ("dead_end", "No fanout connections found", 1, "f0.v"),
    ]
    assert all(h["resolved"] for h in first) and first[4]["role"] == "pipeline" and first[4]["condition"] == "!(!rst_n)"
    rows = traced(spark, tables, "top", "sink")
    assert sorted((h["id"], h["kind"], h["dep"], h["condition"], h["line"]) for h in rows if h["chain"] is None and h["direction"] == "fanin") == [(0, "always", "control", "!rst_n", 6), (1, "always", "data+control", "!(!rst_n)", 7)]
    # the reset's own assignment is a chain by what decides it
    assert [h["signal"] for h in chains(rows, "fanin")[0]] == ["sink", "rst_n"]


def test_missing_modules_slices_and_limits(spark):
    tables = catalog(spark, "module top(input [7:0] a, output y);\n  gone u(.i(a[3:0]), .o(y));\n  assign y = a[0];\n  assign y = a[0];\nendmodule\n")
    rows = traced(spark, tables, "top", "a")
    direct = sorted((h["id"], h["kind"], h["next_module"], h["truncated"]) for h in rows if h["chain"] is None and h["direction"] == "fanout")
    assert direct == [(0, "assign", None, False), (1, "assign", None, False), (2, "instance_pin_in", "gone", False)]
    # a pin of a missing module may drive its net or read it, so it is a hop either way
    assert {h["line"] for h in rows if h["kind"] == "assign"} == {3, 4}
    assert [[h["kind"] for h in x] for x in chains(rows, "fanout")] == [["assign", "instance_pin_in", "dead_end"], ["assign", "instance_pin_in", "dead_end"], ["instance_pin_in", "dead_end"]]
    some = traced(spark, tables, "top", "a", 1)
    assert [(h["kind"], h["truncated"]) for h in some if h["chain"] is None and h["direction"] == "fanout"] == [("assign", True)] and len(chains(some, "fanout")) == 1
    df = traces.trace(tables, spark.createDataFrame([("top", "a"), ("top", "a"), ("none", "x"), (None, None)], "module string, signal string"))
    assert sorted({(r["start_module"], r["module"], r["kind"]) for r in traces.warnings(df, tables["modules"]).where("start_module IS NOT NULL").collect()}) == [("none", "none", "unresolved_module"), ("top", "gone", "unresolved_module")]
    assert {(r["kind"], r["detail"]) for r in df.where("start_module = 'none'").collect()} == {("dead_end", "Module 'none' is not in the project")}
    assert traces.trace(tables, df.select("module", "signal").where("false")).count() == 0


def walk(hops, modules, start, direction, most):
    """Chains as lists of (module, signal, detail) by plain recursion over the hops of each state."""
    of = {}
    for h in sorted((h for h in hops if h["direction"] == direction), key=lambda h: h["place"]):
        key = tuple(h[n] for n in traces.SAME)
        of.setdefault((h["module"], h["signal"]), {}).setdefault(key, h)
    out = []

    def go(at, path, seen):
        if len(out) >= most:
            return
        for h in list(of.get(at, {}).values())[:most] or [None]:
            text = h["detail"] if h else f"No {direction} connections found" if at[0] in modules else f"Module '{at[0]}' is not in the project"
            new = [*path, (*at, text)]
            nexts = [tuple(s) for s in h["states"] if tuple(s) not in seen] if h else []
            for s in nexts:
                go(s, new, seen | {s})
            if not nexts and len(out) < most:
                out.append(new)

    go(start, [], {start})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_are_those_of_a_walk(spark, seed):
    r = random.Random(seed)
    nets = [f"n{k}" for k in range(6)]
    texts = []
    for m in range(3):
        lines = [f"module m{m}(input i, output o); wire {', '.join(nets)};"]
        for k in range(7):
            a, b, x = r.choice([*nets, "o"]), r.choice([*nets, "i"]), r.choice([*nets, "i"])
            lines.append(r.choice([f"assign {a} = {b} & {x};", f"and g{k}({a}, {b}, {x});", f"always @(*) if ({b}) {a} = {x};", f"m{r.choice([0, 1, 2, 9])} u{k}(.i({b}), .o({a}));"]))
        texts.append("\n".join([*lines, "endmodule\n"]))
    tables = catalog(spark, *texts)
    hops, modules = traces.hops(tables).collect(), {"m0", "m1", "m2"}
    starts = [("m0", "n1"), ("m1", "i"), ("m2", "o")]
    asked = spark.createDataFrame(starts, "module string, signal string")
    for most in (4, 40):
        rows = traces.trace(tables, asked, most).where(F.col("chain").isNotNull()).collect()
        for at in starts:
            for way in ("fanin", "fanout"):
                mine = chains([x for x in rows if (x["start_module"], x["start_signal"]) == at], way)
                assert [[(h["module"], h["signal"], h["detail"]) for h in x] for x in mine] == walk(hops, modules, at, way, most)
