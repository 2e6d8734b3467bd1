"""Run logs, summaries and view filters on the driver's tables, beside SQL that states the results by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graphs, runlogs, summaries

_Q: dict = {}


def _query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = (f, sql)
        return f

    return keep


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _form(forms: list, number):
    return F.get(F.array(*map(F.lit, forms)), (number % len(forms)).cast("int"))


def _values(rows: list) -> str:
    text = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, (k, *r))) + ")" for k, r in enumerate(rows))


# A log has one of these lines for each event, with the event's number for #; what follows is worked out by hand:
# kind, verdict, label, whether that is its time, whether it's a warning, whether an assertion failed.
LINES = [
    ("PASS [t=#ns] reset clears count", "pass", "pass", "reset clears count", True, False, False),
    ("FAIL (t = #) increment works: expected 0x1", "fail", "fail", "increment works", True, False, False),
    ("FAIL @# sum: bad", "fail", "fail", "bad", True, False, False),
    ("WARNING: clock skew at time = #", None, None, None, True, True, False),
    ("Assertion failed at time # ns", "fail", "fail", "FAILED", True, False, True),
    ("assertion passed", "pass", "pass", "PASSED", False, False, False),
    ("0 errors, all tests passed", "pass", "pass", "PASSED", False, False, False),
    ("ERROR: node B received 0x41, expected 0x42", "error", "fail", "node B received 0x41, expected 0x42", False, False, False),
    ("$fatal at t=# us : out of range", "fatal", "fail", "out of range", True, False, False),
    ("time=#ps PASSED - idle: low", "pass", "pass", "idle", True, False, False),
    ("no marks here", None, None, None, False, False, False),
]
_SKIPPED = "VCD info: FAIL"
_LOG = f"forms(k, line, kind, verdict, label, timed, warning, assertion) AS (VALUES {_values(LINES)}), log AS (SELECT e.event_id, e.user_id AS run, f.* FROM events e JOIN forms f ON f.k = e.event_id % {len(LINES) + 1})"


def _log(s, d):
    e = _t(s, d, "events")
    line = F.replace(_form([x[0] for x in LINES] + [_SKIPPED], F.col("event_id")), F.lit("#"), F.col("event_id").cast("string"))
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("line_no"), line.alias("line"))


@_query(f"WITH {_LOG} SELECT run, event_id AS line_no, kind, verdict, label, CASE WHEN timed THEN event_id END AS time, warning, assertion FROM log")
def run_log_events(s, d):
    return runlogs.events(_log(s, d)).select("run", "line_no", "kind", "verdict", "label", "time", "warning", "assertion")


_COUNTS = "count(*) FILTER (WHERE kind = 'pass') AS passes, count(*) FILTER (WHERE kind = 'fail') AS fails, count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE kind = 'fatal') AS fatals, count(*) FILTER (WHERE warning) AS warnings, count(*) FILTER (WHERE assertion) AS assertions"
_RUNS = "runs AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 0 END AS exit_code, CASE c_custkey % 7 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' END AS golden FROM customer)"


def _runs(s, d):
    k = F.col("c_custkey")
    return _t(s, d, "customer").select(k.alias("run"), F.when(k % 11 == 0, 2).otherwise(0).alias("exit_code"), F.when(k % 7 == 0, "match").when(k % 7 == 1, "mismatch").alias("golden"))


@_query(f"WITH {_LOG}, {_RUNS}, c AS (SELECT run, {_COUNTS} FROM log GROUP BY run) SELECT r.run, coalesce(passes, 0) AS passes, coalesce(fails, 0) AS fails, coalesce(errors, 0) AS errors, coalesce(fatals, 0) AS fatals, coalesce(warnings, 0) AS warnings, coalesce(assertions, 0) AS assertions FROM runs r LEFT JOIN c ON c.run = r.run")
def run_log_counts(s, d):
    return runlogs.verdicts(runlogs.events(_log(s, d)), _runs(s, d)).select("run", "passes", "fails", "errors", "fatals", "warnings", "assertions")


@_query(f"""WITH {_LOG}, {_RUNS}, c AS (SELECT run, {_COUNTS} FROM log GROUP BY run)
SELECT r.run, CASE WHEN exit_code <> 0 OR golden = 'mismatch' OR coalesce(fails + errors + fatals + assertions, 0) > 0 THEN 'fail' WHEN golden = 'match' OR passes > 0 THEN 'pass' ELSE 'unknown' END AS verdict,
CASE WHEN exit_code <> 0 THEN 'Simulation exited with code 2.' WHEN golden = 'mismatch' THEN 'Output differs from the expected output.'
WHEN coalesce(fails + errors + fatals + assertions, 0) > 0 THEN 'Run reported ' || concat_ws(', ', CASE WHEN fails > 0 THEN fails || ' FAIL marker(s)' END, CASE WHEN errors > 0 THEN errors || ' $error/ERROR line(s)' END, CASE WHEN fatals > 0 THEN fatals || ' $fatal line(s)' END, CASE WHEN assertions > 0 THEN assertions || ' assertion failure(s)' END) || '.'
WHEN golden = 'match' THEN 'Output matches the expected output.' WHEN passes > 0 THEN passes || ' PASS marker(s), no errors.' ELSE 'No PASS/FAIL markers and no golden file.' END AS reason
FROM runs r LEFT JOIN c ON c.run = r.run""")
def run_verdict(s, d):
    return runlogs.verdicts(runlogs.events(_log(s, d)), _runs(s, d)).select("run", "verdict", "reason")


# Worked out by hand: severity, message, file, line.
MESSAGES = [
    ("a/top.v:12: error: no such net", "error", "no such net", "a/top.v", 12),
    ("a/top.v:7: warning implicit wire", "warning", "implicit wire", "a/top.v", 7),
    ("b.v:3: Note: see here", "info", "see here", "b.v", 3),
    ("b.v:40: syntax", "warning", "syntax", "b.v", 40),
    ("b.v:41:", "warning", "b.v:41:", "b.v", 41),
    ("2 error(s) during elaboration.", "info", "2 error(s) during elaboration.", None, None),
]


@_query(f"WITH forms(k, line, severity, message, file, file_line) AS (VALUES {_values(MESSAGES)}) SELECT e.user_id AS run, e.event_id AS line_no, f.severity, f.message, f.file, CAST(f.file_line AS INTEGER) AS file_line FROM events e JOIN forms f ON f.k = e.event_id % {len(MESSAGES)}")
def compiler_messages(s, d):
    lines = _t(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("line_no"), _form([x[0] for x in MESSAGES], F.col("event_id")).alias("line"))
    return runlogs.messages(lines, "warning")


@_query("""SELECT o_orderkey AS run, CASE WHEN o_orderkey % 13 = 0 THEN 'tool_missing' WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 1 OR o_orderkey % 17 = 2 THEN 'compile_error' WHEN o_orderkey % 4 = 1 OR o_orderkey % 6 = 3 THEN 'runtime_error' ELSE 'ok' END AS status FROM orders""")
def run_statuses(s, d):
    k = F.col("o_orderkey")
    code = lambda c: F.when(c, 1).otherwise(0)
    runs = _t(s, d, "orders").select(k.alias("run"), (k % 13 != 0).alias("has_tools"), (k % 7 == 0).alias("compile_timed_out"), code(k % 5 == 1).alias("compile_exit"), (k % 17 != 2).alias("has_image"), (k % 4 == 1).alias("run_timed_out"), code(k % 6 == 3).alias("run_exit"))
    return runlogs.run_status(runs).select("run", "status")


# Worked out by hand: kind, direction, instance, module, label, ports, region.
BLOCKS = [
    ("module_io", "input", "clk", "", "", "", "input_interface"),
    ("module_io", "inout", "bus", "", "", "", "output_interface"),
    ("instance", None, "u_main", "Sched-Core", "", "a b", "decode_control"),
    ("instance", None, "u1", "adder", "x", "a b y RESET_n", "decode_control"),
    ("instance", None, "u2", "up_counter", "q", "a y", "registers"),
    ("instance", None, "u3", "x", "UART-bridge", "a y", "memory_interface"),
    ("instance", None, "u4", "crc8", "y", "a y", "alu_datapath"),
    ("gate", None, None, "and", "g1", None, "logic"),
]


@_query(f"WITH forms(k, kind, direction, instance, module, label, ports, region) AS (VALUES {_values(BLOCKS)}) SELECT p_partkey, f.region FROM part JOIN forms f ON f.k = p_partkey % {len(BLOCKS)}")
def region_classes(s, d):
    field = [_form([b[j] for b in BLOCKS], F.col("p_partkey")) for j in range(6)]
    return _t(s, d, "part").select("p_partkey", scalars.region(field[0], field[1], *field[2:]).alias("region"))


# Worked out by hand.
EXPRESSIONS = [("sel ? a : b", "mux"), ("casez (op) x", "mux"), ("lowercase", "wire"), ("a == b", "comparison"), ("a<=b", "comparison"), ("a <= b", "wire"), ("a << 2", "arithmetic"), ("a & b", "logic"), ("a", "wire"), ("1'b0", "wire"), (" ", None), ("a > b", "comparison"), ("x - y & z", "arithmetic")]


@_query(f"WITH forms(k, e, class) AS (VALUES {_values(EXPRESSIONS)}) SELECT p_partkey, f.class FROM part JOIN forms f ON f.k = p_partkey % {len(EXPRESSIONS)}")
def classify_expression(s, d):
    return _t(s, d, "part").select("p_partkey", scalars.expression_class(_form([e for e, _ in EXPRESSIONS], F.col("p_partkey"))).alias("class"))


# Worked out by hand: kind, style, blocking, role, signal, noise.
HOPS = [
    ("dead_end", None, None, "dead_end", "", True), ("instance_pin_in", None, None, "transport", "a", False), ("module_port_out", "seq", False, "transport", "__open__:u.y", True), ("always", "seq", False, "pipeline", "q", False),
    ("always", "seq", True, "compute", "q", False), ("always", "comb", False, "compute", "__open", False), ("always", None, None, "compute", None, True), ("assign", None, None, "compute", "w", False), ("gate", None, None, "compute", "g", False), ("other", "seq", False, "unknown", "z", False),
]


@_query(f"WITH forms(k, kind, style, blocking, role, signal, noise) AS (VALUES {_values(HOPS)}) SELECT o_orderkey, f.role, f.noise FROM orders JOIN forms f ON f.k = o_orderkey % {len(HOPS)}")
def hop_roles(s, d):
    field = [_form([h[j] for h in HOPS], F.col("o_orderkey")) for j in (0, 1, 2, 4)]
    return _t(s, d, "orders").select("o_orderkey", scalars.hop_role(*field[:3]).alias("role"), scalars.is_noise(field[3]).alias("noise"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') OR o_custkey % 3 = 0")
def meaningful_hops(s, d):
    role = F.when(F.col("o_orderstatus") == "F", "compute").when(F.col("o_orderstatus") == "O", "pipeline").otherwise("transport")
    return summaries.meaningful_hops(_t(s, d, "orders").select("o_orderkey", role.alias("role"), (F.col("o_custkey") % 3 == 0).alias("crosses"))).select("o_orderkey")


_FILES = "files AS (SELECT 'src/f' || s_suppkey || '.v' AS path FROM supplier), modules AS (SELECT c_name AS module, 'src/f' || (c_custkey % 67) || '.v' AS path FROM customer)"


def _files(s, d):
    path = lambda k: F.concat(F.lit("src/f"), k.cast("string"), F.lit(".v")).alias("path")
    return _t(s, d, "supplier").select(path(F.col("s_suppkey"))), _t(s, d, "customer").select(F.col("c_name").alias("module"), path(F.col("c_custkey") % 67))


@_query(f"WITH {_FILES} SELECT f.path, split_part(f.path, '/', 2) AS name, coalesce(string_agg(m.module, ',' ORDER BY m.module), '') AS modules FROM files f LEFT JOIN modules m ON m.path = f.path GROUP BY f.path")
def modules_by_file(s, d):
    return summaries.modules_by_file(*_files(s, d)).withColumn("modules", F.array_join("modules", ","))


@_query(f"WITH {_FILES} SELECT path FROM files WHERE path NOT IN (SELECT path FROM modules)")
def files_without_modules(s, d):
    return summaries.files_without_modules(*_files(s, d))


@_query("""WITH ports AS (SELECT p_size AS node, p_name || p_partkey AS port, CASE p_partkey % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'output' END AS direction, p_partkey FROM part),
n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT node, count(*) FILTER (WHERE direction = 'input') AS inputs, count(*) FILTER (WHERE direction = 'output') AS outputs, count(*) FILTER (WHERE direction IS NULL) AS others, CAST(max(length(port)) AS INTEGER) AS longest, coalesce(max(n), 0) AS busiest FROM ports LEFT JOIN n ON l_partkey = p_partkey GROUP BY node""")
def port_sides(s, d):
    k = F.col("p_partkey")
    named = _t(s, d, "part").select(F.col("p_size").alias("node"), F.concat("p_name", k.cast("string")).alias("port"), F.when(k % 3 == 0, "input").when(k % 3 == 1, "output").alias("direction"), k)
    pins = _t(s, d, "lineitem").join(named, F.col("l_partkey") == k).select("node", "port")
    return summaries.port_sides(named.drop("p_partkey"), pins)


@_query("""WITH e AS (SELECT l_orderkey AS net, l_suppkey AS node, CASE l_returnflag WHEN 'A' THEN 'source' WHEN 'N' THEN 'sink' ELSE 'unknown' END AS role, l_linenumber AS ord, l_linestatus AS class, CAST(l_quantity AS INTEGER) AS width FROM lineitem),
f AS (SELECT net, node, role, min(ord) AS ord FROM e GROUP BY ALL)
SELECT f.net, coalesce(string_agg(CAST(node AS VARCHAR), ',' ORDER BY ord, node) FILTER (WHERE role = 'source'), '') AS sources, coalesce(string_agg(CAST(node AS VARCHAR), ',' ORDER BY ord, node) FILTER (WHERE role = 'sink'), '') AS sinks, any_value(c.class) AS class, any_value(c.width) AS width
FROM f JOIN (SELECT net, class, width FROM e QUALIFY row_number() OVER (PARTITION BY net ORDER BY ord, node, class, width) = 1) c ON c.net = f.net GROUP BY f.net""")
def net_routes(s, d):
    role = F.when(F.col("l_returnflag") == "A", "source").when(F.col("l_returnflag") == "N", "sink").otherwise("unknown")
    ends = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("net"), F.col("l_suppkey").alias("node"), role.alias("role"), F.col("l_linenumber").alias("ord"), F.col("l_linestatus").alias("class"), F.col("l_quantity").cast("int").alias("width"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return summaries.net_routes(ends).select("net", joined("sources"), joined("sinks"), "class", "width")


@_query("SELECT o_orderpriority AS region, min(o_orderkey % 900) - 20 AS x1, min(o_custkey % 700) - 20 AS y1, max(o_orderkey % 900 + 60) + 20 AS x2, max(o_custkey % 700 + 40) + 20 AS y2 FROM orders GROUP BY 1")
def region_boxes(s, d):
    blocks = _t(s, d, "orders").select(F.col("o_orderpriority").alias("region"), (F.col("o_orderkey") % 900).alias("x"), (F.col("o_custkey") % 700).alias("y"), F.lit(60).alias("width"), F.lit(40).alias("height"))
    return summaries.region_boxes(blocks)


@_query("SELECT user_id AS start, count(*) AS collected, least(3, count(DISTINCT event_type)) AS kept, count(*) > least(3, count(DISTINCT event_type)) AS truncated FROM events GROUP BY user_id")
def hops_kept(s, d):
    return summaries.hops_kept(_t(s, d, "events").withColumnRenamed("user_id", "start"), ["event_type"], 3)


_NETS = "nets AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'sys_CLK' WHEN 1 THEN 'tx_ready' WHEN 2 THEN 'done' WHEN 3 THEN 'enable' WHEN 4 THEN 'data_len' WHEN 5 THEN 'Busy2' WHEN 6 THEN 'restart' ELSE 'sum' END AS net, p_size % 3 AS width, p_partkey % 4 AS fanout, CASE p_partkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE 'forward' END AS flow FROM part)"


def _nets(s, d):
    k = F.col("p_partkey")
    return _t(s, d, "part").select(k.alias("id"), F.get(F.array(*map(F.lit, ["sys_CLK", "tx_ready", "done", "enable", "data_len", "Busy2", "restart", "sum", "sum"])), (k % 9).cast("int")).alias("net"), (F.col("p_size") % 3).alias("width"), (k % 4).alias("fanout"), F.when(k % 6 == 0, "unknown").when(k % 6 > 1, "forward").alias("flow"))


@_query(f"WITH {_NETS} SELECT id FROM nets WHERE width > 1 OR fanout > 1 OR net IN ('sys_CLK', 'tx_ready', 'Busy2', 'restart')")
def simplified_edges(s, d):
    return summaries.shown_edges(_nets(s, d), "simplified").select("id")


@_query(f"WITH {_NETS} SELECT id FROM nets WHERE width > 1")
def bus_edges(s, d):
    return summaries.shown_edges(_nets(s, d), "bus").select("id")


@_query(f"WITH {_NETS} SELECT id FROM nets WHERE flow = 'forward'")
def known_edges(s, d):
    return summaries.known_edges(_nets(s, d)).select("id")


@_query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_brand), 're') OR contains(lower(p_type), 're')")
def matching_nodes(s, d):
    return summaries.matching_nodes(_t(s, d, "part"), " Re ", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@_query("SELECT c_mktsegment AS scope, string_agg(c_name, ',' ORDER BY c_name) AS signals FROM customer WHERE contains(lower(c_mktsegment || '.' || c_name), '12') GROUP BY 1")
def signal_scopes(s, d):
    signals = _t(s, d, "customer").select(F.col("c_mktsegment").alias("scope"), F.col("c_name").alias("name"))
    return summaries.scopes(signals, "12").withColumn("signals", F.array_join("signals", ","))


@_query("WITH RECURSIVE a AS (SELECT p_partkey AS node, p_partkey AS k, 0 AS level FROM part UNION ALL SELECT node, k // 2, level + CASE WHEN k % 10 <> 0 THEN 1 ELSE 0 END FROM a WHERE k > 1) SELECT node, CAST(max(level) AS BIGINT) AS level FROM a GROUP BY node")
def layers_of_cycles(s, d):
    """A tree k -> 2k, 2k + 1 with an edge back from every tenth node."""
    n = _t(s, d, "part").select(F.col("p_partkey").alias("node"))
    down = n.where("node > 1").select(F.floor(F.col("node") / 2).alias("src"), F.col("node").alias("dst"))
    back = down.where("dst % 10 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graphs.layers(down.unionAll(back), n).select("node", F.col("level").cast("bigint").alias("level"))


@_query("""WITH RECURSIVE dep AS (SELECT DISTINCT 's' || src AS src, 's' || dst AS dst, dst AS ord FROM (SELECT CAST(n_nationkey AS BIGINT) AS src, (2 * CAST(n_nationkey AS BIGINT) + 1) % 25 AS dst FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), (CAST(n_nationkey AS BIGINT) + 7) % 25 FROM nation) WHERE src <> dst),
p AS (SELECT ['s3'] AS path, [CAST(0 AS BIGINT)] AS o UNION ALL SELECT list_append(p.path, dep.dst), list_append(p.o, dep.ord) FROM p JOIN dep ON dep.src = p.path[len(p.path)] WHERE NOT list_contains(p.path, dep.dst)),
t AS (SELECT path, o FROM p WHERE NOT EXISTS (SELECT 1 FROM dep WHERE dep.src = p.path[len(p.path)] AND NOT list_contains(p.path, dep.dst)))
SELECT array_to_string(path, '>') AS chain FROM t ORDER BY o LIMIT 25""")
def signal_chains(s, d):
    k = F.col("n_nationkey").cast("bigint")
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    dep = _t(s, d, "nation").select(k.alias("a"), F.explode(F.array((2 * k + 1) % 25, (k + 7) % 25)).alias("b")).distinct().where("a <> b")
    return graphs.chains(dep.select(name("a").alias("src"), name("b").alias("dst"), F.col("b").cast("int").alias("ord")), "s3", 25).select(F.array_join("path", ">").alias("chain"))


_OUTPUTS = """e AS (SELECT doc_id AS run, doc_id % 6 AS v, list_transform(string_split(replace('log ' || rtrim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' '), chr(13) || chr(10), chr(10)), chr(10)), lambda x: rtrim(x, chr(9) || chr(13) || ' ')) AS ls FROM documents)"""


def _outputs(s, d):
    """(run, text) of actual and of expected outputs: other line ends and blanks, one blank line more, two, another first line, no output, the same."""
    v, want = F.col("doc_id") % 6, F.concat(F.lit("log "), F.rtrim(F.coalesce("text", F.lit("")), F.lit("\t\n\r ")))
    first = F.regexp_replace(want, "^[^\n]*", "changed")
    got = F.when(v == 0, F.regexp_replace(want, "\r?\n", " \t\r\n")).when(v == 1, F.concat(want, F.lit("\t\n"))).when(v == 2, F.concat(want, F.lit("\n\n"))).when(v == 3, first).when(v == 5, want)
    docs = _t(s, d, "documents")
    return docs.select(F.col("doc_id").alias("run"), got.alias("text")), docs.select(F.col("doc_id").alias("run"), want.alias("text"))


@_query(f"""WITH {_OUTPUTS}, l AS (SELECT run, v, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM e)
SELECT run, CAST(n AS INTEGER) AS line_no, v IN (0, 1, 2, 5) OR (v = 3 AND n > 0) AS same FROM l UNION ALL SELECT run, CAST(len(ls) AS INTEGER), FALSE FROM e WHERE v = 2""")
def golden_lines(s, d):
    return runlogs.compared(*_outputs(s, d)).select("run", F.col("line_no").cast("int").alias("line_no"), "same")


@_query(f"""WITH {_OUTPUTS}, f AS (SELECT *, len(ls) AS n, least(3, len(ls)) AS c, least(4, len(ls)) AS k FROM e),
g AS (SELECT *, '@@ -' || CASE v WHEN 2 THEN (n - c + 1) || CASE c WHEN 1 THEN '' ELSE ',' || c END || ' +' || (n - c + 1) || ',' || (c + 1) WHEN 3 THEN 1 || CASE k WHEN 1 THEN '' ELSE ',' || k END || ' +1' || CASE k WHEN 1 THEN '' ELSE ',' || k END
ELSE 1 || CASE n WHEN 1 THEN '' ELSE ',' || n END || ' +0,0' END || ' @@' AS head FROM f)
SELECT run, v IN (0, 1, 5) AS matched, CASE WHEN v IN (0, 1, 5) THEN '' ELSE array_to_string(list_concat(['--- expected', '+++ actual', head], CASE v WHEN 2 THEN list_concat(list_transform(ls[n - c + 1:], lambda x: ' ' || x), ['+'])
WHEN 3 THEN list_concat(['-' || ls[1], '+changed'], list_transform(ls[2:k], lambda x: ' ' || x)) ELSE list_transform(ls, lambda x: '-' || x) END), chr(10)) END AS diff FROM g""")
def golden_diff(s, d):
    return runlogs.golden_diffs(*_outputs(s, d), most=None).select("run", "matched", F.array_join("diff", "\n").alias("diff"))


def queries() -> dict:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in _Q.items() if sql}
