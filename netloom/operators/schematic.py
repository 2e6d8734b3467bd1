"""Queries of a schematic view: levels, routing of edges, labels, traces over ports, neighbourhoods and places of ports.

Nodes are (id, module, kind, parent, direction), edges (id, module, src, dst, net); ids are unique over all modules, so
all views are answered at once. Ports are of the kinds ``PORT_KINDS`` and name their block in ``parent``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import port_rank, snap

from . import within
from .graphs import apart, cut

PORT_KINDS = ["instance_port", "process_port"]


def with_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with src_block and dst_block: the block of a port, an instance itself; null for other ends."""
    block = F.when(F.col("kind").isin(PORT_KINDS), F.col("parent")).when(F.col("kind") == "instance", F.col("id"))
    of = lambda end: nodes.select(F.col("id").alias(end), block.alias(f"{end}_block"))
    return edges.join(apart(of("src")), "src", "left").join(apart(of("dst")), "dst", "left")


def block_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, src, dst): the blocks that a module's edges lead from and to, other than a block with itself."""
    return _between(with_blocks(nodes, edges))


def _between(e: DataFrame) -> DataFrame:
    return e.select("module", F.col("src_block").alias("src"), F.col("dst_block").alias("dst")).where("src <> dst").distinct()


def _instances(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'instance'").select("module", F.col("id").alias("node"))


def instance_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) of the instances: rounds of Kahn's algorithm; nodes on or behind a cycle then go in the order of their ids, each one more than the highest of its predecessors as these stand by then."""
    return within.settled_levels(_instances(nodes), cut(block_links(nodes, edges))).select("node", "level")


def layout_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, id): a module's input ports; without any, its nodes without an edge to them; else its first node by ``ord``. Ports of blocks don't count."""
    own = nodes.where(~F.col("kind").isin(PORT_KINDS))
    fed = edges.select(F.col("dst").alias("id"), F.lit(True).alias("fed")).distinct()
    first = own.groupBy("module").agg(F.min_by("id", "ord").alias("first"))
    tier = F.when((F.col("kind") == "module_io") & (F.col("direction") == "input"), 1).when(F.col("fed").isNull(), 2).when(F.col("id") == F.col("first"), 3)
    tiers = cut(own.join(apart(fed), "id", "left").join(apart(first), "module").select("module", "id", tier.alias("tier")).where("tier IS NOT NULL"))
    return tiers.join(apart(tiers.groupBy("module").agg(F.min("tier").alias("tier"))), ["module", "tier"], "left_semi").select("module", "id")


def edge_routing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with mode (netlabel or routed) and reason: boundary, feedback (or lateral), long, fanout, else single, which alone is routed.

    A net is one of its module; an edge without a net has a fan-out of one.
    """
    e = cut(with_blocks(nodes, edges))
    levels = cut(within.partial_levels(_instances(nodes), _between(e)).select("node", "level"))
    of = lambda end: levels.select(F.col("node").alias(f"{end}_block"), F.col("level").alias(f"{end}_level"))
    fan = e.where("net IS NOT NULL").groupBy("module", "net").agg(F.count("*").alias("fanout"))
    e = e.join(apart(of("src")), "src_block", "left").join(apart(of("dst")), "dst_block", "left").join(apart(fan), ["module", "net"], "left")
    a, b = F.coalesce("src_level", F.lit(0)), F.coalesce("dst_level", F.lit(0))
    reason = F.when(F.col("src_block").isNull() | F.col("dst_block").isNull(), "boundary").when(a >= b, "feedback").when(b - a > 1, "long").when(F.col("fanout") > 1, "fanout").otherwise("single")
    return e.withColumn("reason", reason).withColumn("mode", F.when(F.col("reason") == "single", "routed").otherwise("netlabel")).select(*edges.columns, "mode", "reason")


def final_modes(routed: DataFrame) -> DataFrame:
    """``edge_routing`` where a port that several edges reach, in whatever modes, has labels only."""
    many = routed.groupBy("dst").agg((F.count("*") > 1).alias("many"))
    return routed.join(apart(many), "dst").withColumn("mode", F.when(F.col("many"), "netlabel").otherwise(F.col("mode"))).select(routed.columns)


def net_labels(routed: DataFrame) -> DataFrame:
    """(role, port, net, text, reason) of labelled edges (src, dst, nets, mode, reason, ord): one of each source and net, one of each target and net, as the first edge gives it. The text of several nets is the first ``+`` how many more."""
    net, more = F.coalesce(F.get("nets", F.lit(0)), F.lit("?")), F.coalesce(F.size("nets"), F.lit(1)) - 1
    text = F.when(more > 0, F.concat(net, F.lit(" +"), more.cast("string"))).otherwise(net)
    side = lambda role, port: F.struct(F.lit(role).alias("role"), F.col(port).alias("port"))
    rows = routed.where("mode = 'netlabel'").select("ord", "reason", net.alias("net"), text.alias("text"), F.explode(F.array(side("source", "src"), side("target", "dst"))).alias("end"))
    return rows.groupBy("end.role", "end.port", "net").agg(F.min_by(F.struct("text", "reason"), "ord").alias("f")).select("role", "port", "net", "f.text", "f.reason")


def unconnected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ports of blocks and modules that no edge ends at."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.where(F.col("kind").isin([*PORT_KINDS, "module_io"])).join(apart(ends), "id", "left_anti")


def neighbourhood(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id): the edges at each node of ``starts`` (node) and at the ports of which it is the parent."""
    ports = nodes.join(apart(starts.select(F.col("node").alias("parent"))), "parent", "left_semi").select(F.col("parent").alias("start"), F.col("id").alias("node"))
    ends = starts.select(F.col("node").alias("start"), "node").unionByName(ports)
    return edges.select("id", F.explode(F.array("src", "dst")).alias("node")).join(apart(ends), "node").select("start", "id").distinct()


def same_net(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id): all edges of the net of each edge of ``starts`` (id), within its module; an edge without a net is alone."""
    keyed = edges.select("id", "module", F.coalesce("net", "id").alias("k"), F.col("net").isNull().alias("alone"))
    picked = keyed.join(apart(starts.select("id").distinct()), "id", "left_semi").select(F.col("id").alias("start"), "module", "k", "alone")
    return picked.join(apart(keyed), ["module", "k", "alone"]).select("start", "id")


def port_trace(nodes: DataFrame, edges: DataFrame, starts: DataFrame, downstream: bool = True) -> DataFrame:
    """(start, port, depth, crossed): ports that edges lead to from each of ``starts`` (node), or back to, by breadth.

    From a port of a block the trace goes on, at the same depth, at the block's outputs (upstream: inputs), marked
    crossed; ports in both directions are not crossed to. A port that a round could both cross to and reach by an edge
    later counts as crossed. Every round drops what is known. What the rounds join is written once: else each
    would make it from ``nodes`` and ``edges`` again.
    """
    here, there, side = ("src", "dst", "output") if downstream else ("dst", "src", "input")
    step = cut(edges.select(F.col(here).alias("at"), F.col(there).alias("port")).distinct())
    ports = cut(nodes.where(F.col("kind").isin(PORT_KINDS) & F.col("parent").isNotNull()).select(F.col("id").alias("port"), "parent", F.lower("direction").alias("direction")))
    far = ports.where(F.col("direction") == side).select("parent", "port")
    onward = lambda df, depth: df.select("start", F.col("port").alias("at")).join(apart(step), "at").select("start", "port").distinct().withColumns({"depth": F.lit(depth), "crossed": F.lit(False)})
    depth = 0
    known = frontier = cut(onward(starts.select(F.col("node").alias("start"), F.col("node").alias("port")), 0))
    while not frontier.isEmpty():
        through = frontier.join(apart(ports), "port").select("start", "parent").distinct().join(apart(far), "parent").select("start", "port")
        crossed = cut(through.join(apart(known), ["start", "port"], "left_anti").withColumns({"depth": F.lit(depth), "crossed": F.lit(True)}))
        known, depth = known.unionByName(crossed), depth + 1
        frontier = cut(onward(frontier.unionByName(crossed), depth).join(apart(known), ["start", "port"], "left_anti"))
        known = known.unionByName(frontier)
    return known


def port_places(blocks: DataFrame, ports: DataFrame) -> DataFrame:
    """(id, parent, side, x, y, label_visible) of ports (id, parent, name, direction, is_bus) on blocks (node, x, y, width, height), x and y the middle.

    Outputs go right, all others left; from the top by rank and name, at least 20 apart. Labels hide on sides of over
    ten ports, but for buses and for clocks, resets and handshakes.
    """
    plain = lambda c: F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "-", "_")
    bus, name = F.coalesce("is_bus", F.lit(False)), plain(F.col("name"))
    p = ports.select("id", "parent", name.alias("name"), bus.alias("bus"), port_rank(name, bus).alias("rank"), F.when(plain(F.col("direction")) == "output", "right").otherwise("left").alias("side"))
    of = Window.partitionBy("parent", "side")
    p = p.withColumns({"n": F.count("*").over(of), "place": F.row_number().over(of.orderBy("rank", "name", "id")) - 1}).join(apart(blocks.withColumnRenamed("node", "parent")), "parent")
    gap = F.when(F.col("n") > 1, F.greatest(F.lit(20.0), (F.col("height") - 56) / F.greatest(F.lit(1), F.col("n") - 1))).otherwise(0.0)
    half = F.col("width") / 2
    return p.select("id", "parent", "side", snap(F.when(F.col("side") == "left", F.col("x") - half).otherwise(F.col("x") + half)).alias("x"), snap(F.col("y") - F.col("height") / 2 + 28 + F.col("place") * gap).alias("y"), ((F.col("n") <= 10) | F.col("bus") | (F.col("rank") <= 2)).alias("label_visible"))


def crowded_regions(blocks: DataFrame, least: int = 12) -> DataFrame:
    """(region, blocks) of regions with many blocks."""
    return blocks.groupBy("region").agg(F.count("*").alias("blocks")).where(F.col("blocks") >= least)
