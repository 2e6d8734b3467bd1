"""The engine's relational operators applied to the driver's tables, each beside the same result in SQL.

Shapes: changes are ``events`` (user_id is the signal, event_id the order); ends are ``lineitem`` (l_orderkey the net,
l_suppkey the node, l_linenumber the port; return flag A is a source, R bidirectional, N a sink); the dependency graph
has an edge k -> (2k+1) mod 25 and k -> (k+7) mod 25 for every nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import design, graphs, summaries, timeline, views

TIMES = ["2024-01-10 00:00:00", "2024-01-20 00:00:00"]


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _times(spark, times=TIMES):
    return spark.createDataFrame([(x,) for x in times], "ts string").select(F.col("ts").cast("timestamp_ntz").alias("ts"))


def _changes(s, d):
    return _t(s, d, "events").select(F.col("user_id").alias("signal"), "ts", "value", F.col("event_id").alias("seq"))


def _ends(s, d):
    role = F.when(F.col("l_returnflag") == "A", "source").when(F.col("l_returnflag") == "R", "bidir").otherwise("sink")
    return _t(s, d, "lineitem").select(F.col("l_orderkey").alias("net"), F.col("l_suppkey").alias("node"), F.col("l_linenumber").cast("bigint").alias("port"), role.alias("role"), F.col("l_quantity").cast("bigint").alias("bit_width"))


def _dep(s, d):
    n = _t(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    return n.select(F.col("k").alias("src"), F.explode(F.array((2 * F.col("k") + 1) % 25, (F.col("k") + 7) % 25)).alias("dst")).distinct().where("src <> dst")


_ENDS = "ends AS (SELECT l_orderkey AS net, l_suppkey AS node, CAST(l_linenumber AS BIGINT) AS port, CASE l_returnflag WHEN 'A' THEN 'source' WHEN 'R' THEN 'bidir' ELSE 'sink' END AS role, CAST(l_quantity AS BIGINT) AS bit_width FROM lineitem)"
_DEP = "dep AS (SELECT DISTINCT src, dst FROM (SELECT CAST(n_nationkey AS BIGINT) AS src, (2 * CAST(n_nationkey AS BIGINT) + 1) % 25 AS dst FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), (CAST(n_nationkey AS BIGINT) + 7) % 25 FROM nation) WHERE src <> dst)"
_Q: dict = {}


def _query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = (f, sql)
        return f

    return keep


@_query("""WITH q AS (SELECT DISTINCT user_id AS signal, t.ts FROM events, (VALUES (TIMESTAMP '2024-01-10 00:00:00'), (TIMESTAMP '2024-01-20 00:00:00')) t(ts))
SELECT q.signal, q.ts, arg_max(e.value, (e.ts, e.event_id)) AS value FROM q JOIN events e ON e.user_id = q.signal AND e.ts <= q.ts GROUP BY q.signal, q.ts""")
def snapshot_at(s, d):
    return timeline.as_of(_changes(s, d), _times(s), "signal", "ts", "seq", "value")


@_query("""WITH q AS (SELECT DISTINCT user_id AS signal, TIMESTAMP '2024-01-01 12:00:00' AS ts FROM events)
SELECT q.signal, q.ts, coalesce(arg_max(e.value, (e.ts, e.event_id)), 0.0) AS value FROM q LEFT JOIN events e ON e.user_id = q.signal AND e.ts <= q.ts GROUP BY q.signal, q.ts""")
def sample_default(s, d):
    return timeline.as_of(_changes(s, d), _times(s, ["2024-01-01 12:00:00"]), "signal", "ts", "seq", "value", default=0.0)


@_query("SELECT event_id, user_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00'")
def waveform_window(s, d):
    first, last = (F.lit(f"2024-01-{day} 12:00:00").cast("timestamp_ntz") for day in (14, 15))
    return timeline.between(_t(s, d, "events"), "ts", first, last).select("event_id", "user_id", "ts", "value")


@_query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark FROM events")
def forward_fill_time(s, d):
    e = _t(s, d, "events").withColumn("mark", F.when(F.col("event_type") == "click", F.col("event_id")))
    return timeline.forward_fill(e, "mark", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "mark")


@_query("SELECT event_id, user_id, event_type, previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE event_type IS DISTINCT FROM previous")
def edge_detect(s, d):
    return timeline.edges(_t(s, d, "events"), "event_type", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "event_type", "previous")


@_query("""WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM a)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS n FROM b GROUP BY user_id, island""")
def islands(s, d):
    x = timeline.islands(_t(s, d, "events"), "event_type", ["ts", "event_id"], ["user_id"])
    return x.groupBy("user_id", "island").agg(F.any_value("event_type").alias("event_type"), F.count("*").alias("n"))


@_query("""WITH f AS (SELECT DISTINCT ts FROM events WHERE event_type = 'error' ORDER BY ts LIMIT 10), q AS (SELECT DISTINCT user_id AS signal, f.ts FROM events, f)
SELECT q.signal, q.ts, arg_max(e.value, (e.ts, e.event_id)) AS value FROM q JOIN events e ON e.user_id = q.signal AND e.ts <= q.ts GROUP BY q.signal, q.ts""")
def failure_snapshots(s, d):
    times = _t(s, d, "events").where("event_type = 'error'").select("ts").distinct().orderBy("ts").limit(10)
    return timeline.as_of(_changes(s, d), times, "signal", "ts", "seq", "value")


@_query(f"WITH {_ENDS} SELECT a.net, a.node AS src, a.port AS src_port, b.node AS dst, b.port AS dst_port FROM ends a JOIN ends b ON a.net = b.net AND a.node <> b.node WHERE a.role IN ('source', 'bidir') AND b.role IN ('sink', 'bidir')")
def compact_edges(s, d):
    return graphs.compact_edges(_ends(s, d))


@_query(f"""WITH {_ENDS}, r AS (SELECT *, row_number() OVER (PARTITION BY net ORDER BY node, port) AS rank, bool_or(role IN ('source', 'bidir')) OVER (PARTITION BY net) AS s, bool_or(role IN ('sink', 'bidir')) OVER (PARTITION BY net) AS k FROM ends)
SELECT a.net, a.node AS a, a.port AS a_port, b.node AS b, b.port AS b_port FROM r a JOIN r b ON a.net = b.net AND a.rank < b.rank AND a.node <> b.node WHERE NOT (a.s AND a.k)""")
def undirected_pairs(s, d):
    return graphs.undirected_pairs(_ends(s, d))


@_query(f"WITH {_ENDS} SELECT net, node, port, 'out' AS flow FROM ends WHERE role IN ('source', 'bidir') UNION ALL SELECT net, node, port, 'in' FROM ends WHERE role IN ('sink', 'bidir')")
def net_edges_detailed(s, d):
    return graphs.net_edges(_ends(s, d))


@_query(f"""WITH {_ENDS}, e AS (SELECT a.net, a.node AS src, b.node AS dst, greatest(a.bit_width, b.bit_width) AS w FROM ends a JOIN ends b ON a.net = b.net AND a.node <> b.node WHERE a.role IN ('source', 'bidir') AND b.role IN ('sink', 'bidir'))
SELECT src, dst, count(DISTINCT net) AS net_count, max(w) AS bit_width, min(net) AS first_net, CASE WHEN bool_and(w > 10) THEN 'bus' WHEN bool_or(w > 10) THEN 'mixed' ELSE 'wire' END AS sig_class FROM e GROUP BY src, dst""")
def aggregate_edges(s, d):
    ends = _ends(s, d)
    a = ends.where("role <> 'sink'").select("net", F.col("node").alias("src"), F.col("bit_width").alias("wa"))
    b = ends.where("role <> 'source'").select("net", F.col("node").alias("dst"), F.col("bit_width").alias("wb"))
    n = graphs.tasks(s)
    e = a.repartition(n, "net").join(graphs.apart(b.repartition(n, "net")), "net").where("src <> dst").withColumn("w", F.greatest("wa", "wb"))
    # nets first, so that the distinct count needs no second copy of the edges
    nets = e.repartition(n, "src", "dst").groupBy("src", "dst", "net").agg(F.max("w").alias("w"), F.min("w").alias("lw"))
    kind = F.when(F.bool_and(F.col("lw") > 10), "bus").when(F.bool_or(F.col("w") > 10), "mixed").otherwise("wire")
    return nets.groupBy("src", "dst").agg(F.count("*").alias("net_count"), F.max("w").alias("bit_width"), F.min("net").alias("first_net"), kind.alias("sig_class"))


@_query(f"WITH {_ENDS} SELECT net, count(*) AS ends, count(*) FILTER (WHERE role <> 'source') AS fanout, max(bit_width) AS bit_width, bool_or(bit_width > 1) AS is_bus FROM ends GROUP BY net")
def net_stats(s, d):
    return summaries.net_stats(_ends(s, d)).drop("control")


@_query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_ports(s, d):
    """An order is a module with one instance, of a module with one port, to which each of its lines connects a signal."""
    insts = _t(s, d, "orders").select(F.col("o_orderkey").alias("module"), F.lit("u").alias("name"), F.lit("line").alias("child"))
    pins = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("module"), F.lit("u").alias("instance"), F.lit("a").alias("child_port"), F.lit("w").alias("parent_signal"))
    ports = s.range(1).select(F.lit("line").alias("module"), F.lit("a").alias("name"), F.lit("input").alias("direction"))
    return views.missing_pins({"instances": insts, "pins": pins, "ports": ports}).select(F.col("module").alias("o_orderkey"))


@_query("SELECT c_custkey, count(o_orderkey) AS children, count(o_orderkey) = 0 AS unresolved FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def unresolved_children(s, d):
    c, o = _t(s, d, "customer").select(F.col("c_custkey").alias("module")), _t(s, d, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_custkey").alias("child"))
    return summaries.child_counts(c, o).select(F.col("module").alias("c_custkey"), "children", (F.col("children") == 0).alias("unresolved"))


@_query("SELECT l_partkey AS child, count(DISTINCT l_suppkey) AS parents, min(l_suppkey) AS first_parent FROM lineitem GROUP BY l_partkey")
def parent_index(s, d):
    return graphs.parents(_t(s, d, "lineitem").select(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("child")))


@_query("""WITH m AS (SELECT p_partkey AS name, p_partkey % 7 = 0 AS tb FROM part),
i AS (SELECT * FROM (SELECT name AS parent, 2 * name AS child, tb FROM m UNION ALL SELECT name, 2 * name + 1, tb FROM m)),
t AS (SELECT name, CASE WHEN name NOT IN (SELECT child FROM i WHERE NOT tb) THEN 1 WHEN name NOT IN (SELECT child FROM i) THEN 2 ELSE 3 END AS tier FROM m WHERE NOT tb),
b AS (SELECT name FROM t WHERE tier = (SELECT min(tier) FROM t)), p AS (SELECT name FROM b WHERE name IN (SELECT parent FROM i WHERE child IN (SELECT name FROM m)))
SELECT name FROM p UNION ALL SELECT name FROM b WHERE NOT EXISTS (SELECT 1 FROM p)""")
def infer_tops(s, d):
    modules = _t(s, d, "part").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") % 7 == 0).alias("is_testbench"))
    links = modules.select(F.col("name").alias("parent"), F.explode(F.array(2 * F.col("name"), 2 * F.col("name") + 1)).alias("child"), F.col("is_testbench").alias("parent_is_testbench"))
    return graphs.infer_tops(modules, links)


@_query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def unused_modules(s, d):
    parts, used = _t(s, d, "part").select(F.col("p_partkey").alias("name")), _t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("child"))
    return graphs.unused(parts, used).select(F.col("name").alias("p_partkey"))


@_query("(SELECT 'lost' AS change, o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT 'lost', o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL (SELECT 'added' AS change, o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT 'added', o_custkey FROM orders WHERE o_orderstatus = 'F')")
def changed_sets(s, d):
    side = lambda x: _t(s, d, "orders").where(F.col("o_orderstatus") == x).select(F.lit("top.v").alias("path"), F.col("o_custkey").alias("module"))
    return design.changed_modules(side("F"), side("O")).select("change", F.col("module").alias("k"))


@_query("""SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS path, CAST(0 AS BIGINT) AS depth FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey || '/n' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def hierarchy_paths(s, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    link = _t(s, d, "nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(_t(s, d, "customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))
    return graphs.hierarchy(link, _t(s, d, "region").select(name("r", "r_regionkey").alias("node"))).select("node", F.array_join("path", "/").alias("path"), F.col("depth").cast("bigint").alias("depth"))


@_query("SELECT n_nationkey, count(c_custkey) AS children FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def child_counts(s, d):
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nations, customers = _t(s, d, "nation").select("n_nationkey", name("n", "n_nationkey").alias("module")), _t(s, d, "customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"))
    found = summaries.child_counts(nations.select("module").unionAll(customers.select("child")), customers)
    return found.join(nations, "module").select("n_nationkey", "children")


@_query(f"WITH {_DEP} SELECT src, dst FROM dep WHERE dst = 8")
def direct_trace_fanin(s, d):
    return _dep(s, d).where("dst = 8")


@_query(f"WITH {_DEP} SELECT src, dst FROM dep WHERE src = 8")
def direct_trace_fanout(s, d):
    return _dep(s, d).where("src = 8")


@_query(f"""WITH RECURSIVE {_DEP}, p AS (SELECT [CAST(3 AS BIGINT)] AS path UNION ALL SELECT list_append(p.path, dep.dst) FROM p JOIN dep ON dep.src = p.path[len(p.path)] WHERE NOT list_contains(p.path, dep.dst)),
t AS (SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM dep WHERE dep.src = p.path[len(p.path)] AND NOT list_contains(p.path, dep.dst)))
SELECT array_to_string(path, '>') AS chain FROM t ORDER BY path LIMIT 25""")
def trace_chains(s, d):
    dep = _dep(s, d).withColumn("ord", F.col("dst").cast("int"))
    return graphs.chains(dep, 3, 25).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("chain"))


@_query(f"WITH RECURSIVE {_DEP}, r AS (SELECT CAST(n_nationkey AS BIGINT) AS start, CAST(n_nationkey AS BIGINT) AS node FROM nation UNION SELECT r.start, dep.dst FROM r JOIN dep ON dep.src = r.node) SELECT start, node FROM r")
def reachability(s, d):
    return graphs.reachable(_dep(s, d), _t(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))).select("start", "node")


@_query(f"WITH RECURSIVE {_DEP}, r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION SELECT dep.dst, r.depth + 1 FROM r JOIN dep ON dep.src = r.node WHERE r.depth < 25) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node")
def bfs_levels(s, d):
    return graphs.reachable(_dep(s, d), s.range(3, 4).select(F.col("id").alias("node"))).select("node", F.col("depth").cast("bigint").alias("depth"))


@_query("WITH RECURSIVE n AS (SELECT p_partkey AS k FROM part), e AS (SELECT n.k AS src, c.k AS dst FROM n JOIN n c ON (c.k = 2 * n.k OR c.k = 2 * n.k + 1) AND c.k <> n.k), r AS (SELECT k AS node, 0 AS level FROM n WHERE k NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node) SELECT node, CAST(max(level) AS BIGINT) AS level FROM r GROUP BY node")
def layers(s, d):
    n = _t(s, d, "part").select(F.col("p_partkey").alias("node"))
    e = n.select(F.col("node").alias("src"), F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("dst")).where("src <> dst").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    return graphs.layers(e, n).select("node", F.col("level").cast("bigint").alias("level"))


@_query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 ORDER BY event_id LIMIT 500")
def hop_dedup_limit(s, d):
    return timeline.first_seen(_t(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id").orderBy("event_id").limit(500)


@_query("SELECT user_id, event_id, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def topk_runs(s, d):
    return summaries.newest(_t(s, d, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id", F.col("n").cast("bigint").alias("n"))


@_query("SELECT p_partkey, CAST(p_size + 1 AS INTEGER) AS bit_width, TRUE AS is_bus FROM part")
def bus_width(s, d):
    w = scalars.bus_width(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(":0]")))
    return _t(s, d, "part").select("p_partkey", w.alias("w")).select("p_partkey", "w.bit_width", "w.is_bus")


@_query("SELECT p_partkey, 'sig' || p_size AS base, '[' || p_size || ':0]' AS slice, CAST(p_size + 1 AS INTEGER) AS width, p_size > 0 AS is_bus FROM part")
def parse_reference(s, d):
    r = scalars.signal_reference(F.concat(F.lit("sig"), F.col("p_size").cast("string"), F.lit("["), F.col("p_size").cast("string"), F.lit(":0]")))
    return _t(s, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.*")


_HAS = lambda *words: "(" + " OR ".join(f"contains(lower(p_name), '{w}')" for w in words) + ")"


@_query(f"""SELECT p_partkey, CAST(CASE WHEN {_HAS('clk', 'clock')} THEN 0 WHEN {_HAS('rst', 'reset', 'clear')} THEN 1 WHEN {_HAS('en', 'start', 'valid', 'ready', 'busy')} THEN 2 WHEN p_size > 10 THEN 3 ELSE 4 END AS INTEGER) AS rank FROM part""")
def port_roles(s, d):
    return _t(s, d, "part").select("p_partkey", scalars.port_rank(F.col("p_name"), F.col("p_size") > 10).alias("rank"))


@_query("SELECT p_partkey, lower(lpad(hex(p_partkey), 8, '0')) AS digits FROM part")
def bus_radix(s, d):
    return _t(s, d, "part").select("p_partkey", scalars.hex_digits(F.bin("p_partkey"), F.lit(32)).alias("digits"))


@_query("WITH x AS (SELECT p_partkey, CAST(p_partkey % 256 AS BIGINT) AS v FROM part) SELECT p_partkey, 'b' || lpad(bin(v), 8, '0') AS bin, 'h' || lpad(hex(v), 2, '0') AS hex, CAST(v AS VARCHAR) AS dec, CAST(CASE WHEN v > 127 THEN v - 256 ELSE v END AS VARCHAR) AS sdec FROM x")
def bus_values(s, d):
    bits = F.lpad(F.bin((F.col("p_partkey") % 256).cast("bigint")), 8, "0")
    return _t(s, d, "part").select("p_partkey", *[scalars.bus_value(bits, F.lit(8), r).alias(r) for r in ("bin", "hex", "dec", "sdec")])


@_query("WITH x AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_custkey AS t FROM orders) SELECT o_orderkey, CASE WHEN t >= 1000000000 THEN 'G' WHEN t >= 1000000 THEN 'M' WHEN t >= 1000 THEN 'k' ELSE CAST(t AS VARCHAR) END AS unit FROM x")
def time_units(s, d):
    text = scalars.time_text(F.col("o_orderkey").cast("bigint") * F.col("o_custkey"))
    return _t(s, d, "orders").select("o_orderkey", F.when(text.rlike("[kMG]$"), F.right(text, F.lit(1))).otherwise(text).alias("unit"))


@_query("SELECT p_partkey, CASE p_partkey WHEN 0 THEN 'p00000' ELSE 'p' || lpad(CAST(length(CAST(p_partkey AS VARCHAR)) AS VARCHAR), 5, '0') || p_partkey END AS key FROM part")
def natural_keys(s, d):
    return _t(s, d, "part").select("p_partkey", scalars.natural_key(F.concat(F.lit("P00"), F.col("p_partkey").cast("string"))).alias("key"))


@_query(f"SELECT p_partkey FROM part WHERE {_HAS('clk', 'clock', 'rst', 'reset', 'en', 'start', 'valid', 'ready', 'busy', 'done')}")
def control_names(s, d):
    return _t(s, d, "part").where(scalars.is_control_name(F.col("p_name"))).select("p_partkey")


@_query("SELECT doc_id, md5(CASE WHEN length(text) <= 200 THEN text ELSE left(text, 100) || chr(10) || '…[' || (length(text) - 200) || ' chars truncated]…' || chr(10) || right(text, 100) END) AS digest FROM documents")
def shortened_texts(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(scalars.shortened(F.col("text"), 200)).alias("digest"))


@_query("SELECT p_partkey, CAST(round_even(p_retailprice / 20, 0) * 20 AS BIGINT) AS grid FROM part")
def snap_grid(s, d):
    return _t(s, d, "part").select("p_partkey", scalars.snap(F.col("p_retailprice")).alias("grid"))


@_query("SELECT doc_id, CAST(n AS BIGINT) AS line_no, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) WHERE regexp_matches(l, 'th[ae]') ORDER BY doc_id, n LIMIT 40")
def search_lines(s, d):
    lines = _t(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike("th[ae]")).orderBy("doc_id", "n").limit(40).select("doc_id", (F.col("n") + 1).cast("bigint").alias("line_no"), "line")


@_query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00') OR contains(lower(c_mktsegment), 'auto')")
def signal_filter(s, d):
    named = _t(s, d, "customer").withColumn("full_name", F.concat_ws(".", "c_mktsegment", "c_name"))
    return summaries.naming(named, ["00", "AUTO"], "full_name").select("c_custkey", "c_name")


@_query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_$]*'))) AS BIGINT) AS n FROM documents")
def identifiers(s, d):
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return _t(s, d, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all(ascii_, F.lit("[A-Za-z_][A-Za-z0-9_$]*"), 0))).cast("bigint").alias("n"))


@_query("SELECT page_id, CAST(length(html) - length(replace(html, '<', '')) AS BIGINT) AS opened, CAST(length(html) - length(replace(html, '>', '')) AS BIGINT) AS closed FROM pages")
def bracket_balance(s, d):
    n = lambda c: (F.length("html") - F.length(F.replace(F.col("html"), F.lit(c), F.lit("")))).cast("bigint")
    return _t(s, d, "pages").select("page_id", n("<").alias("opened"), n(">").alias("closed"))


@_query("""WITH a AS (SELECT turn, conv_id, text FROM conversations WHERE role = 'user'), b AS (SELECT turn - 1 AS turn, conv_id, text FROM conversations WHERE role = 'assistant')
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS line_no, a.text IS NOT DISTINCT FROM b.text AS same FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def golden_diff_flags(s, d):
    c = _t(s, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", F.col("turn").alias("line_no"), F.col("text").alias("want"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("line_no"), F.col("text").alias("got"))
    return a.join(b, ["conv_id", "line_no"], "full_outer").select("conv_id", "line_no", F.col("want").eqNullSafe(F.col("got")).alias("same"))


@_query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 4) AS rolling FROM events")
def rolling_tokens(s, d):
    e = _t(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return timeline.rolling_sum(e, "value", "us", 86400000000, ["user_id"]).select("event_id", "user_id", F.round("rolling", 4).alias("rolling"))


@_query("SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_linestatus")
def kind_counts(s, d):
    return summaries.counts_by_kind(_t(s, d, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"]).toDF("l_linestatus", "a", "n", "r")


@_query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS severe FROM events GROUP BY event_type")
def severity_counts(s, d):
    e = _t(s, d, "events").withColumn("severity", F.when(F.col("value") > 50, "severe").otherwise("other"))
    found = summaries.counts_by_kind(e, "event_type", "severity", ["severe", "other"])
    return found.select("event_type", (F.col("severe") + F.col("other")).alias("n"), "severe")


def queries() -> dict:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items() if sql}
