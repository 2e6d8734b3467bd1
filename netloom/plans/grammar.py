"""Every form of a Verilog statement, and broken ones, in a file rendered for each part, beside rows worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import rtl
from .bridge import _t

_Q: dict = {}
TEXT = """module f{k} (
  input [7:0] a, b, output y, inout z);
  wire p = a, q = b[0];
  wire [3:0] m1, m2; // one; line
  foo{k} u1 (.x(a), .y(f(g(h(i(j(a))))))), u2 (b, , y);
  foo{k} (.x(q));
  bar #(.W(f(2))) u3 [3:0] (.p({a, {b, y}}), .q(), .r);
  and g1 (n1, a, b), g2 (n2, p, q);
  nor (n3, a, b), (n4, p, q);
  assign y = p, m1 = {n1, n2};
  always @(posedge a[0]) begin m2 <= m1; end
  {broken}
  wire last;
endmodule
{tail}
"""
BROKEN = ["(* keep *) reg [W(1)-1:0] kept = 3;", "foo u9 (.a(b);", "assign = 3;", "end"]
TAIL = ["stray words;", "module g{k} (input a);", "endmodule", "`define X 1", ""]
_K = "SELECT p_partkey AS k, 'f' || p_partkey AS module FROM part"


def _query(sql: str):
    def keep(f):
        _Q[f.__name__] = (f, sql)
        return f

    return keep


def _files(s, d):
    k = F.col("p_partkey")
    pick = lambda texts: F.get(F.array(*map(F.lit, texts)), (k % len(texts)).cast("int"))
    text = F.lit(TEXT)
    for name, value in (("{broken}", pick(BROKEN)), ("{tail}", pick(TAIL)), ("{k}", k.cast("string"))):
        text = F.replace(text, F.lit(name), value)
    parts = _t(s, d, "part").select("p_partkey").repartition(rtl.tasks(s), "p_partkey")  # else the texts are made by as few tasks as the table has blocks
    return parts.select(F.concat(F.lit("f"), k.cast("string"), F.lit(".v")).alias("path"), text.alias("text"))


def _mods(s, d, *kinds):
    return rtl.modules(_files(s, d), kinds)


@_query(f"SELECT k.module, v.name, replace(v.child, '#', CAST(k AS VARCHAR)) AS child, v.line FROM ({_K}) k, (VALUES ('u1', 'foo#', 5), ('u2', 'foo#', 5), ('inst_0', 'foo#', 6), ('u3', 'bar', 7)) v(name, child, line)")
def statement_instances(s, d):
    return rtl.instances(_mods(s, d, "instance")).select("module", "name", "child", "line")


@_query(f"""SELECT k.module, v.instance, v.ord, v.child_port, v.parent_signal FROM ({_K}) k, (VALUES ('u1', 0, 'x', 'a'), ('u1', 1, 'y', 'f(g(h(i(j(a)))))'), ('u2', 0, 'arg0', 'b'), ('u2', 1, 'arg1', ''), ('u2', 2, 'arg2', 'y'),
('inst_0', 0, 'x', 'q'), ('u3', 0, 'p', '{{a, {{b, y}}}}'), ('u3', 1, 'q', ''), ('u3', 2, 'r', 'r')) v(instance, ord, child_port, parent_signal)""")
def statement_pins(s, d):
    return rtl.pins(rtl.instances(_mods(s, d, "instance"))).select("module", "instance", "ord", "child_port", "parent_signal")


@_query(f"SELECT k.module, v.* FROM ({_K}) k, (VALUES ('g1', 'and', 'n1', 'a,b', 8), ('g2', 'and', 'n2', 'p,q', 8), ('nor_0', 'nor', 'n3', 'a,b', 9), ('nor_1', 'nor', 'n4', 'p,q', 9)) v(name, gate_type, output, inputs, line)")
def statement_gates(s, d):
    return rtl.gates(_mods(s, d, "gate")).select("module", "name", "gate_type", "output", F.array_join("inputs", ",").alias("inputs"), "line")


@_query(f"SELECT k.module, v.* FROM ({_K}) k, (VALUES ('p', 'a', 'a', 3), ('q', 'b[0]', 'b', 3), ('y', 'p', 'p', 10), ('m1', '{{n1, n2}}', 'n1,n2', 10)) v(target, expression, sources, line)")
def statement_assigns(s, d):
    return rtl.assigns(_mods(s, d, "assign", "declaration")).select("module", "target", "expression", F.array_join("sources", ",").alias("sources"), "line")


@_query(f"""SELECT k.module, v.* FROM ({_K}) k, (VALUES ('p', 'wire', 1, FALSE, 3), ('q', 'wire', 1, FALSE, 3), ('m1', 'wire', 4, TRUE, 4), ('m2', 'wire', 4, TRUE, 4), ('last', 'wire', 1, FALSE, 13), ('kept', 'reg', NULL, TRUE, 12)) v(name, kind, bit_width, is_bus, line)
WHERE v.name <> 'kept' OR k % 4 = 0""")
def statement_signals(s, d):
    return rtl.signals(_mods(s, d, "declaration")).select("module", "name", "kind", "bit_width", "is_bus", "line")


@_query(f"SELECT module, 'posedge a[0]' AS sensitivity, 'ALWAYS @(posedge a[0])' AS title, 'SEQ posedge a' AS label, 'm2' AS target, 11 AS line FROM ({_K}) k")
def statement_always(s, d):
    return rtl.always_blocks(_mods(s, d, "always")).select("module", "sensitivity", "title", "label", F.get("steps", F.lit(0))["target"].alias("target"), "line")


@_query(f"""SELECT k.module || '.v' AS path, v.severity, v.kind, v.line, v.token, replace(v.text, '#', CAST(k AS VARCHAR)) AS text FROM ({_K}) k, (VALUES
(4, 1, 'error', 'parse_failure', 12, '(', 'foo u9 (.a(b);'), (4, 2, 'error', 'parse_failure', 12, '=', 'assign = 3;'), (4, 3, 'error', 'parse_failure', 12, 'end', 'end'),
(5, 0, 'warning', 'outside_module', 15, 'stray', 'stray words;'), (5, 1, 'error', 'parse_failure', 15, 'module', 'module g# (input a);'), (5, 2, 'error', 'parse_failure', 15, 'endmodule', 'endmodule')) v(m, r, severity, kind, line, token, text) WHERE k % m = r""")
def rtl_diagnostics(s, d):
    return rtl.diagnostics(_files(s, d)).select("path", "severity", "kind", "line", "token", "text")


def queries() -> dict:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items()}
