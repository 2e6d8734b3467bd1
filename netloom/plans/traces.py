"""Traces with their chains and steps, of a design rendered for each part, beside rows worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design, traces
from ..sources import rtl
from .bridge import _t

_Q: dict = {}
TEXT = """module t# (input clk, input [7:0] d, input en, output reg [7:0] q, output ok);
  wire [7:0] m;
  wire n; // what the child finds
  wire [1:0] r;
  assign m = en ? d : q;
  always @(posedge clk) begin
    if (en)
      q <= m;
  end
  s# u0 (.x(m[3:0]), .y(n));
  and g0 (ok, n, en, r);
  gone u1 (.z(n));
  assign r[0] = 1'b0, r[1] = ~1'b1;
endmodule
module s# (input [3:0] x, output y);
  assign y = x == 4'd3;
endmodule
"""
# the hops that a trace of ok meets; # is the part
_HOPS = """h(h, direction, module, signal, kind, role, op_category, label, detail, dep, crosses, next_module, next_signal, line) AS (VALUES
('ok', 'fanin', 't#', 'ok', 'gate', 'compute', 'wire', 'and g0', 'ok <- n, en, r', NULL, NULL, NULL, NULL, 11),
('n0', 'fanin', 't#', 'n', 'instance_pin_out', 'transport', NULL, 'u0.y', 'from s#.y', NULL, 'down', 's#', 'y', 10),
('n1', 'fanin', 't#', 'n', 'instance_pin_out', 'transport', NULL, 'u1.z', 'from gone.z', NULL, 'down', 'gone', 'z', 12),
('y', 'fanin', 's#', 'y', 'assign', 'compute', 'comparison', 'assign y', 'y = x == 4''d3', 'data', NULL, NULL, NULL, 16),
('x', 'fanin', 's#', 'x', 'module_port_in', 'transport', NULL, 't#.u0', '↑ t#.m', NULL, 'up', 't#', 'm', 10),
('m', 'fanin', 't#', 'm', 'assign', 'compute', 'mux', 'assign m', 'm = en ? d : q', 'data', NULL, NULL, NULL, 5),
('q', 'fanin', 't#', 'q', 'always', 'pipeline', 'wire', 'always always_0', 'q <= m', 'data+control', NULL, NULL, NULL, 8),
('r0', 'fanin', 't#', 'r', 'assign', 'compute', 'wire', 'assign r[0]', 'r[0] = 1''b0', 'data', NULL, NULL, NULL, 13),
('r1', 'fanin', 't#', 'r', 'assign', 'compute', 'logic', 'assign r[1]', 'r[1] = ~1''b1', 'data', NULL, NULL, NULL, 13),
('en', 'fanin', 't#', 'en', 'dead_end', 'dead_end', NULL, 'dead end: en', 'No fanin connections found', NULL, NULL, NULL, NULL, 1),
('d', 'fanin', 't#', 'd', 'dead_end', 'dead_end', NULL, 'dead end: d', 'No fanin connections found', NULL, NULL, NULL, NULL, 1),
('z', 'fanin', 'gone', 'z', 'dead_end', 'dead_end', NULL, 'module not found: gone', 'Module ''gone'' is not in the project', NULL, NULL, NULL, NULL, NULL),
('ok', 'fanout', 't#', 'ok', 'dead_end', 'dead_end', NULL, 'dead end: ok', 'No fanout connections found', NULL, NULL, NULL, NULL, 1))"""
_CHAINS = """w(direction, chain, hops) AS (VALUES ('fanin', NULL, 'ok'), ('fanin', 0, 'ok,n0,y,x,m,en'), ('fanin', 1, 'ok,n0,y,x,m,d'), ('fanin', 2, 'ok,n0,y,x,m,q,en'), ('fanin', 3, 'ok,n1,z'), ('fanin', 4, 'ok,en'), ('fanin', 5, 'ok,r0'), ('fanin', 6, 'ok,r1'),
('fanout', NULL, 'ok'), ('fanout', 0, 'ok')),
l AS (SELECT direction, chain, unnest(string_split(hops, ',')) AS h, unnest(range(len(string_split(hops, ',')))) AS pos FROM w)"""
_K = "k AS (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part)"


def _query(sql: str):
    def keep(f):
        _Q[f.__name__] = (f, sql)
        return f

    return keep


def _design(s, d):
    k = F.col("p_partkey").cast("string")
    files = _t(s, d, "part").select(F.concat(F.lit("t"), k, F.lit(".v")).alias("path"), F.replace(F.lit(TEXT), F.lit("#"), k).alias("text"))
    return design.catalog(rtl.modules(files))


def _traced(s, d):
    """The traces of output ok of the modules of all parts."""
    tables = _design(s, d)
    outputs = tables["ports"].where("name = 'ok'").select("module", F.col("name").alias("signal"))
    return traces.trace(tables, outputs), tables


@_query(f"""WITH {_K}, {_HOPS}, {_CHAINS} SELECT 't' || k AS start_module, h.direction, CAST(chain AS INTEGER) AS chain, CASE WHEN chain IS NOT NULL THEN CAST(pos AS INTEGER) END AS pos, replace(module, '#', k) AS module, signal, kind, role, op_category,
replace(label, '#', k) AS label, replace(detail, '#', k) AS detail, dep, crosses, replace(next_module, '#', k) AS next_module, next_signal, line FROM k, l JOIN h ON h.h = l.h AND h.direction = l.direction""")
def rtl_trace(s, d):
    return _traced(s, d)[0].select("start_module", "direction", "chain", "pos", "module", "signal", "kind", "role", "op_category", "label", "detail", "dep", "crosses", "next_module", "next_signal", "line")


@_query(f"""WITH {_K}, v(step, direction, module, signal, label, role, variants, ops, line) AS (VALUES (0, 'fanin', 't#', 'r', 'r[0] = 1''b0', 'compute', 2, 'logic', 13), (1, 'fanin', 'gone', 'z', 'module not found: gone', 'dead_end', 1, '', NULL),
(2, 'fanin', 'gone', 'z', '↓ gone.z', 'transport', 1, '', 12), (3, 'fanin', 't#', 'q', 'q ← m', 'pipeline', 1, '', 8), (4, 'fanin', 't#', 'd', 'dead end: d', 'dead_end', 1, '', 1), (5, 'fanin', 't#', 'en', 'dead end: en', 'dead_end', 1, '', 1),
(6, 'fanin', 't#', 'm', 'm = en ? d : q', 'compute', 1, 'mux', 5), (7, 'fanin', 't#', 'm', '↑ t#.m', 'transport', 1, '', 10), (8, 'fanin', 's#', 'y', 'y = x == 4''d3', 'compute', 1, 'comparison', 16), (9, 'fanin', 's#', 'y', '↓ s#.y', 'transport', 1, '', 10),
(10, 'fanin', 't#', 'ok', 'ok <- n, en, r', 'compute', 1, '', 11), (11, 'fanout', 't#', 'ok', 'dead end: ok', 'dead_end', 1, '', 1))
SELECT 't' || k AS start_module, step, direction, replace(module, '#', k) AS module, signal, replace(label, '#', k) AS label, role, CAST(variants AS BIGINT) AS variants, ops, line FROM k, v""")
def rtl_steps(s, d):
    return traces.steps(_traced(s, d)[0]).select("start_module", "step", "direction", "module", "signal", "label", "role", "variants", F.array_join("ops", ",").alias("ops"), "line")


@_query("SELECT 't' || p_partkey AS start_module, 'unresolved_module' AS kind, 'gone' AS module FROM part")
def rtl_trace_warnings(s, d):
    rows, tables = _traced(s, d)
    return traces.warnings(rows, tables["modules"]).select("start_module", "kind", "module")


def queries() -> dict:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items()}
