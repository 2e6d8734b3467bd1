"""Sources, graphs, geometry and streams on the driver's tables, each beside the same result in SQL.

Designs are rendered from ``part``: module p<k> reads port a, instantiates p<2k> and p<2k+1>, and drives port b. Dumps are
rendered from ``events``: a user is a signal, an event's id a value. Both are then read back by the sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design, geometry, graphs, lint, runlogs, views
from ..sources import files as project_files
from ..sources import formats, rtl, vcd
from ..streaming import budget
from ..streaming import events as streams
from .bridge import _DEP, _dep, _t

_Q: dict = {}
MODULE = """module p{k} ( // part {k}
  input wire [7:0] a, input c, output reg [7:0] b);
  wire [7:0] w;
  p{l} u0 (.a(a), .c(c), .b(w));
  p{r} u1 (.a(w), .c(), .b(x));
  assign y = w ^ a;
  always @(posedge c) if (a) b <= w;
endmodule
"""


def _query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = (f, sql)
        return f

    return keep


def _texts(s, d):
    """(f, text): the modules of all parts, a hundred to a file."""
    k = F.col("p_partkey")
    text = F.replace(F.replace(F.replace(F.lit(MODULE), F.lit("{k}"), k.cast("string")), F.lit("{l}"), (2 * k).cast("string")), F.lit("{r}"), (2 * k + 1).cast("string"))
    return _t(s, d, "part").groupBy(F.floor(k / 100).alias("f")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def _design(s, d):
    return design.catalog(rtl.modules(_texts(s, d).select(F.format_string("p%08d.v", "f").alias("path"), "text")))


@_query("SELECT 'p' || p_partkey AS module, i.name, 'p' || (2 * p_partkey + i.o) AS child, CAST((p_partkey - mn) * 9 + 4 + i.o AS BIGINT) AS line FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_partkey // 100) AS mn FROM part), (VALUES ('u0', 0), ('u1', 1)) i(name, o)")
def rtl_instances(s, d):
    return _design(s, d)["instances"].select("module", "name", "child", F.col("line").cast("bigint").alias("line"))


@_query("SELECT 'p' || p_partkey AS module, name, direction, CAST(w AS BIGINT) AS bit_width FROM part, (VALUES ('a', 'input', 8), ('c', 'input', 1), ('b', 'output', 8)) v(name, direction, w)")
def rtl_ports(s, d):
    return _design(s, d)["ports"].select("module", "name", "direction", F.col("bit_width").cast("bigint").alias("bit_width"))


_HOPS = """m AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part), l AS (SELECT m.k, c.k AS ck, c.k - 2 * m.k AS o FROM m JOIN m c ON c.k = 2 * m.k OR c.k = 2 * m.k + 1),
h AS (SELECT 'p' || k AS module, target, 'p' || k AS next_module, source, kind, dep FROM m, (VALUES ('y', 'w', 'assign', 'data'), ('y', 'a', 'assign', 'data'), ('b', 'w', 'always', 'data'), ('b', 'a', 'always', 'control')) v(target, source, kind, dep)
UNION ALL SELECT 'p' || k, CASE o WHEN 0 THEN 'w' ELSE 'x' END, 'p' || ck, 'b', 'instance', 'data' FROM l
UNION ALL SELECT 'p' || ck, 'a', 'p' || k, CASE o WHEN 0 THEN 'a' ELSE 'w' END, 'port', 'data' FROM l
UNION ALL SELECT 'p' || ck, 'c', 'p' || k, 'c', 'port', 'data' FROM l WHERE o = 0)"""


@_query(f"WITH {_HOPS} SELECT * FROM h")
def rtl_hops(s, d):
    return design.hops(_design(s, d))


@_query(f"WITH RECURSIVE {_HOPS}, e AS (SELECT module || '.' || target AS src, next_module || '.' || source AS dst FROM h), t AS (SELECT 'p1.b' AS start, 'p1.b' AS node UNION SELECT t.start, e.dst FROM t JOIN e ON e.src = t.node) SELECT start, node FROM t")
def rtl_fanin(s, d):
    """All that output b of the top module depends on."""
    edges = graphs.cut(design.hop_edges(design.hops(_design(s, d))))
    return graphs.reachable(edges, s.range(1).select(F.lit("p1.b").alias("node"))).select("start", "node")


_EDGES = """WITH m AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part), x AS (SELECT k, 2 * k IN (SELECT k FROM m) AS has0, 2 * k + 1 IN (SELECT k FROM m) AS has1 FROM m), e AS (
SELECT k, 'a' AS net, 'io:a' AS src, 'assign:1:y' AS dst, 'directed' AS flow FROM x UNION ALL SELECT k, 'a', 'io:a', 'always:2', 'directed' FROM x
UNION ALL SELECT k, 'a', 'io:a', 'instance:u0', 'directed' FROM x WHERE has0
UNION ALL SELECT k, 'c', 'io:c', 'always:2', 'directed' FROM x UNION ALL SELECT k, 'c', 'io:c', 'instance:u0', 'directed' FROM x WHERE has0
UNION ALL SELECT k, 'b', 'always:2', 'io:b', 'directed' FROM x
UNION ALL SELECT k, 'w', 'instance:u0', 'assign:1:y', 'directed' FROM x WHERE has0 UNION ALL SELECT k, 'w', 'instance:u0', 'always:2', 'directed' FROM x WHERE has0
UNION ALL SELECT k, 'w', 'instance:u0', 'instance:u1', 'directed' FROM x WHERE has0 AND has1
UNION ALL SELECT k, 'w', 'always:2', 'assign:1:y', 'unknown' FROM x WHERE NOT has0 UNION ALL SELECT k, 'w', 'always:2', 'instance:u0', 'unknown' FROM x WHERE NOT has0 UNION ALL SELECT k, 'w', 'always:2', 'instance:u1', 'unknown' FROM x WHERE NOT has0)
SELECT 'p' || k AS module, net, replace(replace(src, 'assign:1', 'assign:3'), 'always:2', 'always:4') AS src, replace(replace(dst, 'assign:1', 'assign:3'), 'always:2', 'always:4') AS dst, flow FROM e"""


@_query(_EDGES)
def rtl_connectivity(s, d):
    return design.connectivity(design.endpoints(_design(s, d))).select("module", "net", "src", "dst", "flow")


@_query(f"""SELECT module, src, dst, flow, count(*) AS net_count, string_agg(net, ',' ORDER BY net) AS nets, CAST(max(CASE net WHEN 'c' THEN 1 ELSE 8 END) AS BIGINT) AS bit_width,
CASE WHEN bool_and(net <> 'c') THEN 'bus' WHEN bool_and(net = 'c') THEN 'wire' ELSE 'mixed' END AS sig_class FROM ({_EDGES}) q GROUP BY module, src, dst, flow""")
def rtl_aggregate_edges(s, d):
    found = views.aggregated(design.connectivity(design.endpoints(_design(s, d))))
    return found.select("module", "src", "dst", "flow", "net_count", F.array_join("nets", ",").alias("nets"), F.col("bit_width").cast("bigint").alias("bit_width"), "sig_class")


@_query("""WITH x AS (SELECT k, 2 * k IN (SELECT p_partkey FROM part) AS has0, 2 * k + 1 IN (SELECT p_partkey FROM part) AS has1 FROM (SELECT CAST(p_partkey AS BIGINT) AS k FROM part)),
v(net, node, role) AS (VALUES ('a', 'io:a', 'source'), ('a', 'assign:3:y', 'sink'), ('a', 'always:4', 'sink'), ('c', 'io:c', 'source'), ('c', 'always:4', 'sink'), ('b', 'always:4', 'source'), ('b', 'io:b', 'sink'),
('w', 'assign:3:y', 'sink'), ('w', 'always:4', 'sink'), ('y', 'assign:3:y', 'source'), ('a', 'instance:u0', 'sink'), ('c', 'instance:u0', 'sink'), ('w', 'instance:u0', 'source'), ('w', 'instance:u1', 'sink'), ('__open__:u1.c', 'instance:u1', 'sink'), ('x', 'instance:u1', 'source')),
e AS (SELECT k, net, node, CASE WHEN (node = 'instance:u0' AND NOT has0) OR (node = 'instance:u1' AND NOT has1) THEN 'unknown' ELSE role END AS role FROM x, v)
SELECT 'p' || k AS module, CASE role WHEN 'source' THEN node ELSE 'net:' || net END AS src, CASE role WHEN 'source' THEN 'net:' || net ELSE node END AS dst, CASE role WHEN 'unknown' THEN role ELSE 'directed' END AS flow FROM e""")
def rtl_net_graph(s, d):
    return views.net_graph(design.endpoints(_design(s, d))).select("module", "src", "dst", "flow")


@_query("""WITH RECURSIVE t AS (SELECT CAST(1 AS BIGINT) AS k, 'p1' AS path, CAST(0 AS BIGINT) AS depth UNION ALL
SELECT 2 * t.k + i.o, t.path || '/' || i.name || ':p' || (2 * t.k + i.o), t.depth + 1 FROM t JOIN (VALUES ('u0', 0), ('u1', 1)) i(name, o) ON t.k IN (SELECT p_partkey FROM part))
SELECT path, 'p' || k AS module, depth, k IN (SELECT p_partkey FROM part) AS resolved FROM t""")
def rtl_instance_tree(s, d):
    tree = views.instance_tree(_design(s, d), s.range(1).select(F.lit("p1").alias("node")))
    return tree.select("path", "module", F.col("depth").cast("bigint").alias("depth"), "resolved")


@_query("SELECT 'p' || p_partkey AS module, 'u1' AS instance, 'c' AS child_port, 'input' AS direction, TRUE AS open FROM part WHERE 2 * p_partkey + 1 IN (SELECT p_partkey FROM part)")
def rtl_missing_pins(s, d):
    return views.missing_pins(_design(s, d)).select("module", "instance", "child_port", "direction", "open")


def _files(s, d):
    """Documents as files: every fifth is named like a test bench."""
    k = F.col("doc_id").cast("string")
    return _t(s, d, "documents").select(F.concat(F.when(F.col("doc_id") % 5 == 0, "tb_").otherwise("d"), k, F.lit(".v")).alias("path"), "text")


_FILES = "f AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'tb_' ELSE 'd' END || doc_id || '.v' AS path, text FROM documents)"


@_query(f"WITH {_FILES} SELECT path, 'discovered' AS source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM f WHERE path LIKE 'tb#_%' ESCAPE '#' OR regexp_matches(left(text, 8192), '[$](dumpvars|dumpfile|finish|monitor)')")
def test_bench_files(s, d):
    return project_files.test_benches(_files(s, d)).select("path", "source", F.col("size").cast("bigint").alias("size"))


@_query(f"""WITH {_FILES}, l AS (SELECT path, unnest(regexp_split_to_array(text, chr(13) || chr(10) || '|' || chr(10) || '|' || chr(13))) AS line FROM f) SELECT path, count(*) AS n FROM l WHERE regexp_matches(line, 'th[ae]') GROUP BY path""")
def search_files(s, d):
    return project_files.search(_files(s, d), "th[ae]", limit=None).groupBy("path").agg(F.count("*").alias("n"))


@_query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, md5(CAST(conv_id AS VARCHAR)) AS commit, role AS author_name, CAST(turn AS VARCHAR) || ' of ' || CAST(conv_id AS VARCHAR) AS subject FROM conversations")
def commit_rows(s, d):
    """Each conversation as a listing of commits, a turn each."""
    k = F.col("conv_id").cast("string")
    turn = F.col("turn").cast("string")
    record = F.concat_ws(project_files.FIELD, F.md5(k), F.left(F.md5(k), F.lit(7)), "role", F.lit("e@x"), F.lit("2024-01-01"), F.concat(turn, F.lit(" of "), k))
    listing = _t(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", record.alias("r")))), lambda x: x["r"]), f"{project_files.RECORD}\n").alias("text"))
    return project_files.commits(listing).select("conv_id", F.substring_index("subject", " ", 1).cast("bigint").alias("turn"), "commit", "author_name", "subject")


@_query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 0 ELSE 2 END AS errors FROM part")
def lint_files(s, d):
    """Errors of each part's text: with a bracket too many, none, or two blocks that stay open."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "module m; // begin\n x = (1)); endmodule").when(k % 3 == 1, "module m; begin x = \"(\"; end endmodule").otherwise("module m; begin case (a) endmodule")
    parts = _t(s, d, "part").select("p_partkey", text.alias("text"))
    found = lint.lint(parts.select(k.cast("string").alias("path"), "text")).groupBy(F.col("path").cast("bigint").alias("k")).agg(F.count("*").cast("int").alias("errors"))
    return parts.select("p_partkey").join(found, k == F.col("k"), "left").select("p_partkey", F.coalesce("errors", F.lit(0)).alias("errors"))


def _dump(s, d):
    return vcd.lines(s, _dumped(s, d))


def _dumped(s, d):
    """A new folder of dumps of all events, one file for each of 64 groups of users."""
    e = _t(s, d, "events").select((F.pmod("user_id", F.lit(64))).alias("bucket"), F.col("user_id").alias("u"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("v"))
    users = e.select("bucket", "u").distinct()
    line = lambda df, part, t, v, text: df.select("bucket", F.lit(part).alias("part"), t.alias("t"), v.alias("v"), text.alias("value"))
    zero, name = F.lit(-1).cast("bigint"), F.col("u").cast("string")
    head = line(users, 1, zero, F.col("u"), F.concat(F.lit("$var real 64 u"), name, F.lit(" user"), name, F.lit(" $end")))
    ends = [line(users.select("bucket").distinct(), p, zero, zero, F.lit(x)) for p, x in ((0, "$scope module top $end"), (2, "$upscope $end"), (3, "$enddefinitions $end"))]
    times = line(e.select("bucket", "t").distinct(), 4, F.col("t"), zero, F.concat(F.lit("#"), F.col("t").cast("string")))
    rows = head.unionByName(times).unionByName(line(e, 4, F.col("t"), F.col("v"), F.concat(F.lit("r"), F.col("v").cast("string"), F.lit(" u"), name)))
    for x in ends:
        rows = rows.unionByName(x)
    path = graphs.new_path(s, "dump")
    rows.repartition("bucket").sortWithinPartitions("bucket", "part", "t", "v").select("bucket", "value").write.partitionBy("bucket").text(path)
    return path


@_query("SELECT 'top.user' || user_id AS full_name, CAST(floor(epoch(ts)) AS BIGINT) AS time, CAST(event_id AS VARCHAR) AS value FROM events WHERE user_id % 7 = 3")
def vcd_format(s, d):
    """Changes of some signals, chosen while the dumps are read."""
    formats.register(s)
    wanted = [f"top.user{r[0]}" for r in _t(s, d, "events").where("user_id % 7 = 3").select("user_id").distinct().collect()]
    found = s.read.format("vcd").option("endings", ".txt").load(_dumped(s, d))
    return found.where(F.col("full_name").isin(wanted)).select("full_name", "time", "value")


@_query("SELECT 'p' || p_partkey AS module, i.name, 'p' || (2 * p_partkey + i.o) AS child FROM part, (VALUES ('u0', 0), ('u1', 1)) i(name, o)")
def rtl_format(s, d):
    """The modules of all parts, written as files and read by their format."""
    formats.register(s)
    path = graphs.new_path(s, "design")
    _texts(s, d).repartition("f").select("f", F.col("text").alias("value")).write.partitionBy("f").text(path)
    mods = s.read.format("rtl").option("endings", ".txt").option("group_bytes", 1 << 20).load(path)
    return rtl.instances(mods).select("module", "name", "child")


@_query("SELECT 'top.user' || user_id AS full_name, CAST(floor(epoch(ts)) AS BIGINT) AS time, CAST(event_id AS VARCHAR) AS value FROM events")
def vcd_changes(s, d):
    lines = _dump(s, d)
    return vcd.changes(lines, vcd.signals(lines, None)).select("full_name", "time", "value")


@_query(f"WITH RECURSIVE {_DEP}, r AS (SELECT src AS a, dst AS b FROM dep UNION SELECT r.a, dep.dst FROM r JOIN dep ON dep.src = r.b) SELECT CAST(n_nationkey AS BIGINT) AS node, greatest(CAST(n_nationkey AS BIGINT), coalesce((SELECT max(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = n_nationkey), -1)) AS component FROM nation")
def strong_components(s, d):
    return graphs.strong_components(_dep(s, d), _t(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("node")))


@_query("SELECT h.k AS h, v.s AS v FROM (SELECT o_orderkey AS k, o_custkey % 997 AS y, o_orderkey % 5000 AS x1, o_orderkey % 5000 + 1 + o_orderkey % 90 AS x2 FROM orders) h JOIN (SELECT s_suppkey AS s, s_suppkey * 37 % 5000 AS x, s_nationkey * 30 AS y1, s_nationkey * 30 + 60 AS y2 FROM supplier) v ON x1 < x AND x < x2 AND y1 < y AND y < y2")
def route_crossings(s, d):
    k = F.col("o_orderkey")
    level = _t(s, d, "orders").select(k.alias("h"), (F.col("o_custkey") % 997).alias("y"), (k % 5000).alias("x1"), (k % 5000 + 1 + k % 90).alias("x2"))
    upright = _t(s, d, "supplier").select(F.col("s_suppkey").alias("v"), (F.col("s_suppkey") * 37 % 5000).alias("x"), (F.col("s_nationkey") * 30).alias("y1"), (F.col("s_nationkey") * 30 + 60).alias("y2"))
    return geometry.crossings(level, upright)


@_query("""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents),
v AS (SELECT doc_id, upper(regexp_extract(line, '(?i)(^|[^A-Za-z0-9_])(PASSED|PASS|FAILURE|FAILED|FAIL|ERROR|FATAL)([^A-Za-z0-9_]|$)', 2)) AS w FROM l)
SELECT d.doc_id AS run, count(*) FILTER (WHERE w IN ('PASS', 'PASSED')) AS passes, count(*) FILTER (WHERE w IN ('FAIL', 'FAILED', 'FAILURE')) AS fails, count(*) FILTER (WHERE w = 'ERROR') AS errors FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY d.doc_id""")
def log_verdicts(s, d):
    docs = _t(s, d, "documents")
    runs = docs.select(F.col("doc_id").alias("run"), F.lit(0).alias("exit_code"), F.lit(None).cast("string").alias("golden"))
    return runlogs.verdicts(runlogs.events(runlogs.log_lines(docs, "doc_id", "text")), runs).select("run", "passes", "fails", "errors")


def _stream(s, d):
    return streams.stream(s, f"{d}/events.parque[t]")


@_query("""WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY start, event_type""")
def stream_tumbling(s, d):
    out = streams.drain_whole(streams.tumbling(_stream(s, d), "ts", "event_type", "value"), graphs.new_path(s, "tumbling"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@_query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a), c AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS n FROM b GROUP BY user_id, k) SELECT * FROM c""")
def stream_sessions(s, d):
    out = streams.drain_whole(streams.sessions(_stream(s, d), "ts", "user_id"), graphs.new_path(s, "sessions"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("until"), "n")


@_query("SELECT event_id FROM events WHERE event_id > 100")
def stream_since(s, d):
    return streams.drain(streams.since(_stream(s, d), "event_id", 100).select("event_id"), graphs.new_path(s, "since"))


@_query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 4) AS spent FROM events")
def stream_budget(s, d):
    """What each user has spent in the day up to each event, by a stream with state."""
    out = budget.spent(_stream(s, d), graphs.new_path(s, "budget"), "user_id", "ts", "event_id", "value")
    return out.select(F.col("id").alias("event_id"), "user_id", F.round("spent", 4).alias("spent"))


def queries() -> dict:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items() if sql}
