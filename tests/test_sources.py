"""The design and waveform sources on small inputs of their own."""

import pytest
from pyspark.sql import functions as F

from netloom.sources import rtl, vcd

DESIGN = """
// module ghost (input x); endmodule
module leaf #(parameter W = 8, parameter D = (W + 1)) (
  input clk, rst_n,
  input wire [7:0] a, /* two
  lines */ output reg [7:0] q
);
  wire [7:0] mid = a ^ 8'hF0;
  reg [3:0] count, spare;
  integer i;
  assign lonely = "a // b; endmodul";
  and g1 (x, a, rst_n);
  not (y, x);
  always @(posedge clk or negedge rst_n) begin : main
    if (!rst_n) q <= 8'd0;
    else if (a == mid) begin
      for (i = 0; i < 4; i = i + 1) count[i] <= a[i];
    end else
      case (count)
        4'd0, 4'd1: q <= mid;
        default: q <= q + 1;
      endcase
  end
  always @(*) spare = count;
  function [3:0] f; input x; f = x; endfunction
  generate if (W > 1) begin leaf2 hidden (.a(a)); end endgenerate
  initial begin $display("x"); end
endmodule

module top (clk, d);
  leaf #(.W(8), .D(9)) u0 (.clk(clk), .rst_n(), .a({d, d[3:0]}), .q(q_out[7:0]));
  leaf u1 (clk, d);
  missing u2 (.p(f(x, y)));
endmodule
"""
DUMP = """$date
   #99
$end
$timescale 1ns $end
$scope module tb $end
$var wire 1 ! clk $end
$scope module dut $end
$var reg 8 " data [7:0] $end
$var reg 8 ! alias $end
$upscope $end
$var real x % level $end
$upscope $end
$enddefinitions $end
$dumpvars
0!
b0000xxxx "
$end
#5
1!
r1.5 %
#5
0!
1?
#20
b1 "
#30
"""


@pytest.fixture(scope="module")
def mods(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("rtl")
    (root / "a.SV").write_text(DESIGN)
    (root / "empty.v").write_text("")
    (root / "broken.v").write_text("module half (input a);\n")
    (root / "notes.txt").write_text("module no; endmodule")
    (root / "venv").mkdir()
    (root / "venv" / "b.v").write_text("module hidden; endmodule")
    files = rtl.scan(spark, str(root)).cache()
    return files, rtl.modules(files).cache()


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_scan_and_modules(mods):
    assert sorted(p.rsplit("/", 1)[1] for (p,) in rows(mods[0], "path")) == ["a.SV", "broken.v"]
    assert rows(mods[1].orderBy("mod_ord"), "module", "line") == [("leaf", 3), ("top", 30)]
    assert [p.rsplit("/", 1)[1] for (p,) in rows(rtl.diagnostics(*mods), "path")] == ["broken.v"]


def test_ports(mods):
    found = rows(rtl.ports(mods[1]).orderBy("module", "ord"), "module", "name", "direction", "bit_width", "is_bus")
    assert found == [
        ("leaf", "clk", "input", 1, False), ("leaf", "rst_n", "input", 1, False), ("leaf", "a", "input", 8, True), ("leaf", "q", "output", 8, True),
        ("top", "clk", "unknown", 1, False), ("top", "d", "unknown", 1, False),
    ]


def test_signals_assigns_gates(mods):
    assert rows(rtl.signals(mods[1]).orderBy("ord"), "name", "kind", "bit_width", "line") == [("mid", "wire", 8, 8), ("count", "reg", 4, 9), ("spare", "reg", 4, 9)]
    assert rows(rtl.assigns(mods[1]).orderBy("idx"), "target", "expression", "sources") == [("mid", "a ^ 8'hF0", ["a"]), ("lonely", '"a // b; endmodul"', ["a", "b", "endmodul"])]
    assert rows(rtl.assigns(mods[1], decl_assigns=False), "target") == [("lonely",)]
    assert rows(rtl.gates(mods[1]).orderBy("ord"), "gate_type", "output", "inputs") == [("and", "x", ["a", "rst_n"]), ("not", "y", ["x"])]


def test_instances_and_pins(mods):
    insts = rtl.instances(mods[1])
    assert rows(insts.orderBy("ord"), "module", "name", "child") == [("top", "u0", "leaf"), ("top", "u1", "leaf"), ("top", "u2", "missing")]
    found = rows(rtl.pins(insts).orderBy("instance", "ord"), "instance", "child_port", "parent_signal")
    assert found == [
        ("u0", "clk", "clk"), ("u0", "rst_n", ""), ("u0", "a", "{d, d[3:0]}"), ("u0", "q", "q_out[7:0]"),
        ("u1", "arg0", "clk"), ("u1", "arg1", "d"), ("u2", "p", "f(x, y)"),
    ]


def test_always(mods):
    blocks = rtl.always_blocks(mods[1])
    assert rows(blocks.orderBy("ord"), "style", "polarity", "clock") == [("seq", "mixed", "clk"), ("comb", "level", None)]
    found = rows(rtl.always_assigns(blocks).orderBy("block", "ord"), "target", "expression", "blocking", "condition", "condition_signals")
    assert found == [
        ("q", "8'd0", False, "!rst_n", ["rst_n"]),
        ("count[i]", "a[i]", False, "a == mid", ["rst_n", "a", "mid"]),
        ("q", "mid", False, "count", ["rst_n", "a", "mid", "count"]),
        ("q", "q + 1", False, "count", ["rst_n", "a", "mid", "count"]),
        ("spare", "count", True, None, []),
    ]


@pytest.mark.parametrize("blocks", [1, 8])
def test_dump(spark, tmp_path, blocks):
    """Eight small blocks give the same as a whole file: times carry over their borders."""
    (tmp_path / "a.vcd").write_text(DUMP)
    spark.conf.set("spark.sql.files.minPartitionNum", str(blocks))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = vcd.lines(spark, str(tmp_path / "a.vcd")).cache()
        declared = vcd.signals(lines)
        assert rows(declared.orderBy("ord"), "id", "full_name", "kind", "width") == [("!", "tb.clk", "wire", 1), ('"', "tb.dut.data [7:0]", "reg", 8), ("%", "tb.level", "real", 1)]
        found = rows(vcd.changes(lines, declared).orderBy("seq"), "full_name", "time", "value")
        assert found == [("tb.clk", 0, "0"), ("tb.dut.data [7:0]", 0, "0000xxxx"), ("tb.clk", 5, "1"), ("tb.level", 5, "1.5"), ("tb.clk", 5, "0"), ("tb.dut.data [7:0]", 20, "1")]
        assert rows(vcd.end_times(lines), "end_time") == [(30,)]
        assert lines.select("block").distinct().count() == blocks
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


FORMS = """module m (input a, output y);
  wire p = a, q = b[0];
  foo u1 (.x(a)), u2 (a, , y);
  foo (.x(f(g(h(i(j(a)))))));
  and g1 (n1, a, b), g2 (n2, p, q), (n3, a);
  or (n4, a, b);
  assign y = p, m = n;
  foo u9 (.a(b);
  assign = 3;
  end
  bogus text here
  wire [3:0] ok;
  case_t x;
  always @(posedge a) begin y <= 1;
endmodule
loose words
module (input a); endmodule
module late (input a);
module fine; endmodule : fine
endmodule
"""


def test_every_form_of_a_statement_and_every_stretch_of_text(spark):
    files = spark.createDataFrame([("f.v", FORMS), ("none.v", None)], "path string, text string")
    found = rtl.modules(files).cache()
    assert rows(found, "module", "line") == [("m", 1), ("fine", 19)]
    assert rows(rtl.instances(found), "name", "child", "line") == [("u1", "foo", 3), ("u2", "foo", 3), ("inst_0", "foo", 4)]
    assert rows(rtl.pins(rtl.instances(found)), "instance", "child_port", "parent_signal") == [("u1", "x", "a"), ("u2", "arg0", "a"), ("u2", "arg1", ""), ("u2", "arg2", "y"), ("inst_0", "x", "f(g(h(i(j(a)))))")]
    assert rows(rtl.gates(found), "name", "output", "inputs") == [("g1", "n1", ["a", "b"]), ("g2", "n2", ["p", "q"]), ("and_0", "n3", ["a"]), ("or_1", "n4", ["a", "b"])]
    assert rows(rtl.assigns(found, decl_assigns=False), "target", "expression") == [("y", "p"), ("m", "n")]
    assert rows(rtl.signals(found), "name", "width") == [("p", None), ("q", None), ("ok", "[3:0]")]
    assert rows(rtl.diagnostics(files), "kind", "line", "token", "message") == [
        ("read_failure", None, None, "the file could not be read"),
        ("parse_failure", 8, "(", "'(' is never closed"), ("parse_failure", 9, "=", "a target and '=' are expected"), ("parse_failure", 10, "end", "'end' closes nothing"),
        ("parse_failure", 11, "here", "'(' is expected"), ("parse_failure", 13, ";", "'(' is expected"), ("parse_failure", 14, "always", "the statement never ends"),
        ("outside_module", 16, "loose", "the text is in no module"), ("parse_failure", 17, "(", "the module has no name"), ("parse_failure", 18, "module", "the module never ends"), ("parse_failure", 20, "endmodule", "endmodule closes nothing"),
    ]


def test_no_token_vanishes():
    """Whatever is cut out of a text or put into it, each token is in an item, in a report, or a module's own."""
    import random

    from netloom.sources import verilog

    draw = random.Random(2)
    tokens = [t.group() for t in verilog.TOKEN.finditer(FORMS)]
    for _ in range(300):
        some = list(tokens)
        for _ in range(draw.randrange(1, 6)):
            at = draw.randrange(len(some))
            some[at : at + draw.randrange(3)] = draw.choices(tokens, k=draw.randrange(3))
        reader = verilog.Reader("\n".join(some))
        seen = [0] * len(some)
        made, lost, listed = verilog.Reader.item, verilog.Reader.report, verilog.Reader.ports

        def item(self, i):
            k, out = made(self, i)
            assert k > i
            seen[i:k] = [1] * (k - i)
            return k, out

        def report(self, kind, i, j, message, at=None):
            seen[i:j] = [1] * (j - i)
            lost(self, kind, i, j, message, at)

        def ports(self, i, j):
            out = listed(self, i, j)
            seen[i:j] = [1] * (j - i)
            return out

        verilog.Reader.item, verilog.Reader.report, verilog.Reader.ports = item, report, ports
        try:
            mods = reader.file()
        finally:
            verilog.Reader.item, verilog.Reader.report, verilog.Reader.ports = made, lost, listed
        assert all(seen[i] or some[i] in ("module", "endmodule", ":", "fine") for i in range(len(some))) if not mods else sum(not x for x in seen) <= len(mods) * 10 + some.count("endmodule")


def test_formats_give_the_same_rows(spark, tmp_path):
    from netloom.sources import formats

    formats.register(spark)
    (tmp_path / "d" / "venv").mkdir(parents=True)
    for name, text in (("a.SV", DESIGN), ("b.v", FORMS), ("venv/c.v", DESIGN), ("x y.v", "module spaced; endmodule // module no; endmodule"), ("no.txt", DESIGN), ("empty.v", "")):
        (tmp_path / "d" / name).write_text(text)
    root = str(tmp_path / "d")
    read = spark.read.format("rtl").option("group_bytes", 1).load(root)
    want = rtl.modules(rtl.scan(spark, root))
    assert sorted(map(repr, read.collect())) == sorted(map(repr, want.collect()))
    assert read.rdd.getNumPartitions() == 4
    one = read.where("path LIKE '%/b.v'")
    assert one.rdd.getNumPartitions() == 1 and rows(one, "module") == [("m",), ("fine",)]
    assert rows(rtl.instances(read.where("module = 'top'")), "name") == [("u0",), ("u1",), ("u2",)]

    (tmp_path / "a.vcd").write_text(DUMP)
    dump = spark.read.format("vcd").load(str(tmp_path / "a.vcd"))
    lines = vcd.lines(spark, str(tmp_path / "a.vcd"))
    assert sorted(dump.collect()) == sorted(vcd.changes(lines, vcd.signals(lines)).collect())
    assert rows(dump.where("full_name = 'tb.clk' AND time > 0").orderBy("seq"), "time", "value") == [(5, "1"), (5, "0")]


def test_files_of_one_block_are_read_by_many_tasks_in_pieces(spark):
    module = "module m{k} (input a); // b\n  wire w; /* x\n */ foo u (.p(a));\nendmodule\n"
    texts = [(f"f{n}.v", "".join(module.replace("{k}", f"{n}_{k}") for k in range(5000))) for n in range(3)] + [("empty.v", ""), ("unread.v", None)]
    files = spark.createDataFrame(texts, "path string, text string").coalesce(1)
    assert all(len(t or "") > rtl.PIECE or not t for _, t in texts)
    mods = rtl.modules(files)
    assert mods.rdd.getNumPartitions() >= rtl.TASKS
    assert [tuple(r) for r in mods.groupBy("path").agg(F.count("*"), F.min("mod_ord"), F.max("mod_ord"), F.countDistinct("module")).orderBy("path").collect()] == [(f"f{n}.v", 5000, 0, 4999, 5000) for n in range(3)]
    assert rtl.instances(mods).where("line % 4 = 0").count() == 0 and rtl.instances(mods).where("line % 4 = 3").count() == 15000
    assert [tuple(r) for r in rtl.diagnostics(files).select("path", "kind").collect()] == [("unread.v", "read_failure")]


def test_texts_of_diagnostics_are_whole(spark):
    stray, pins = "stray " * 400 + "end_of_it;", ", ".join(f".p{k}(a{k})" for k in range(300))
    files = spark.createDataFrame([("f.v", f"{stray}\nmodule m (input a);\n  foo u ({pins}, .q(b);\n  assign y = a;\nendmodule\n")], "path string, text string")
    assert rows(rtl.diagnostics(files), "kind", "line", "text") == [("outside_module", 1, stray), ("parse_failure", 3, f"foo u ({pins}, .q(b);")]
