"""Graphs inside modules, beside SQL: an order is a module, its lines are nodes, and each line leads to the lines that its part and its supplier name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import within
from .bridge import _t

_Q: dict = {}


def _query(sql: str):
    def keep(f):
        _Q[f.__name__] = (f, sql)
        return f

    return keep


def _graph(s, d):
    lines = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_linenumber").cast("bigint").alias("node"), "l_partkey", "l_suppkey")
    edges = lines.select("module", F.col("node").alias("src"), F.explode(F.array((F.col("l_partkey") % 7 + 1).cast("bigint"), (F.col("l_suppkey") % 7 + 1).cast("bigint"))).alias("dst"))
    return lines.select("module", "node").distinct(), edges


_GRAPH = """WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS module, CAST(l_linenumber AS BIGINT) AS node FROM lineitem),
e AS (SELECT DISTINCT x.module, x.src, x.dst FROM (SELECT l_orderkey AS module, CAST(l_linenumber AS BIGINT) AS src, CAST(unnest([l_partkey % 7 + 1, l_suppkey % 7 + 1]) AS BIGINT) AS dst FROM lineitem) x JOIN n ON n.module = x.module AND n.node = x.dst WHERE src <> dst),
r AS (SELECT module, node AS start, node, 0 AS depth FROM n UNION SELECT r.module, r.start, e.dst, r.depth + 1 FROM r JOIN e ON e.module = r.module AND e.src = r.node WHERE r.depth < 7),
p AS (SELECT DISTINCT module, start, node FROM r), c AS (SELECT a.module, a.start AS node, max(a.node) AS component FROM p a JOIN p b ON b.module = a.module AND b.start = a.node AND b.node = a.start GROUP BY ALL)"""


@_query(f"{_GRAPH} SELECT module, node, component FROM c")
def module_components(s, d):
    return within.components(*_graph(s, d))


@_query(f"""{_GRAPH}, b AS (SELECT DISTINCT e.module, x.component AS src, y.component AS dst FROM e JOIN c x ON x.module = e.module AND x.node = e.src JOIN c y ON y.module = e.module AND y.node = e.dst WHERE x.component <> y.component),
l AS (SELECT DISTINCT module, component, 0 AS level FROM c UNION SELECT l.module, b.dst, l.level + 1 FROM l JOIN b ON b.module = l.module AND b.src = l.component)
SELECT c.module, c.node, CAST(max(l.level) AS BIGINT) AS level FROM c JOIN l ON l.module = c.module AND l.component = c.component GROUP BY ALL""")
def module_layers(s, d):
    return within.layers(*_graph(s, d)).select("module", "node", F.col("level").cast("bigint").alias("level"))


@_query(f"{_GRAPH} SELECT module, start, node, CAST(min(depth) AS BIGINT) AS depth FROM r JOIN n USING (module, node) GROUP BY ALL")
def module_reach(s, d):
    nodes, edges = _graph(s, d)
    known = edges.join(nodes.withColumnRenamed("node", "dst"), ["module", "dst"], "left_semi")
    return within.reachable(known, nodes).select("module", "start", "node", F.col("depth").cast("bigint").alias("depth"))


def queries() -> dict:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items()}
