"""Operators on graphs: nets to edges, reachability, layers, chains, components and hierarchies."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a graph's tables that may go to all tasks.
FEW = 100_000


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder named by spark.checkpoint.dir; in one of our own only where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{tempfile.gettempdir()}/netloom-shared"
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that loops keep short plans."""
    path = new_path(df.sparkSession, "graphs")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts both sides, for tables that grow with a design.

    Spark guesses the size of exploded rows and of files that compress well far too low, and would then collect them in
    the driver to send them to all tasks.
    """
    return df.hint("merge")


def tasks(spark: SparkSession) -> int:
    """How many tasks share sorting or Python work on a whole table. Given as a number, Spark keeps to it; by itself it joins partitions by their compressed size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def sides(*tables: DataFrame):
    """What rounds do with the tables that they join: ``apart`` where one of ``tables`` has over ``FEW`` rows, else nothing."""
    return apart if any(t.count() > FEW for t in tables) else lambda df: df


def compact_edges(ends: DataFrame) -> DataFrame:
    """(net, src, dst): sources x sinks of each net, other than a node with itself; bidirectional ends are both.

    A net's sources and sinks meet in a join on the net, which the size of a net bounds.
    """
    src = ends.where(F.col("role").isin("source", "bidir")).select("net", F.col("node").alias("src"), F.col("port").alias("src_port"))
    dst = ends.where(F.col("role").isin("sink", "bidir")).select("net", F.col("node").alias("dst"), F.col("port").alias("dst_port"))
    return src.join(dst, "net").where("src <> dst")


def undirected_pairs(ends: DataFrame) -> DataFrame:
    """(net, a, b): the ordered pairs of ends of nets that lack sources or lack sinks, other than a node with itself."""
    has = ends.groupBy("net").agg(F.bool_or(F.col("role").isin("source", "bidir")).alias("s"), F.bool_or(F.col("role").isin("sink", "bidir")).alias("k")).where(~(F.col("s") & F.col("k"))).select("net")
    ranked = ends.join(has, "net", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("net").orderBy("node", "port")))
    left = ranked.select("net", F.col("node").alias("a"), F.col("port").alias("a_port"), F.col("rank").alias("ra"))
    right = ranked.select("net", F.col("node").alias("b"), F.col("port").alias("b_port"), F.col("rank").alias("rb"))
    return left.join(right, "net").where("ra < rb and a <> b").drop("ra", "rb")


def net_edges(ends: DataFrame) -> DataFrame:
    """(net, node, port, flow): out for sources into the net, in for sinks; bidirectional ends give both, unknown ones unknown."""
    flow = F.when(F.col("role") == "source", F.array(F.lit("out"))).when(F.col("role") == "sink", F.array(F.lit("in"))).when(F.col("role") == "bidir", F.array(F.lit("out"), F.lit("in"))).otherwise(F.array(F.lit("unknown")))
    return ends.select("net", "node", "port", F.explode(flow).alias("flow"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth): what can be reached over (src, dst), with the least number of steps; starts at depth 0.

    Semi-naive: each round joins only what the last one found, and drops what is known.
    """
    known = cut(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = known, 0
    while not frontier.isEmpty():
        depth += 1
        new = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct().join(known, ["start", "node"], "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(depth)))
        known = known.unionByName(frontier)
    return known


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): the longest path from a node without predecessors; nodes that reach each other share a level.

    Rounds of Kahn's algorithm on all nodes at once: a node is placed in the round after its last predecessor. Where a
    cycle stops the rounds, they start again on the graph of strong components. Edges to other nodes are ignored.
    """
    return _kahn(edges, nodes) or _of_components(edges, nodes)


def _of_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    known = lambda c: nodes.select(F.col("node").alias(c)).distinct()
    side = sides(nodes, edges)
    edges = edges.select("src", "dst").join(side(known("src")), "src").join(side(known("dst")), "dst")
    of = strong_components(edges, nodes)
    end = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    between = cut(edges.join(side(end("src")), "src").join(side(end("dst")), "dst").where("c_src <> c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct())
    levels = _kahn(between, of.select(F.col("component").alias("node"))).withColumnRenamed("node", "component")
    return of.join(side(levels), "component").select("node", "level")


def _rounds(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, level) of what the rounds place, and the nodes left over on and behind cycles."""
    left, edge, placed, level = cut(nodes.select("node").distinct()), cut(edges.distinct()), None, 0
    while not left.isEmpty():
        side = sides(left, edge)
        now = left.join(side(edge.select(F.col("dst").alias("node"))), "node", "left_anti")
        now = cut(now.withColumn("level", F.lit(level)))
        if now.isEmpty():
            break
        placed = now if placed is None else placed.unionByName(now)
        left = cut(left.join(side(now), "node", "left_anti"))
        edge = cut(edge.join(side(now.select(F.col("node").alias("src"))), "src", "left_anti"))
        level += 1
    return (placed if placed is not None else nodes.select("node").where("false").withColumn("level", F.lit(0))), left


def _kahn(edges: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """The levels, or None on a cycle."""
    placed, left = _rounds(edges, nodes)
    return placed if left.isEmpty() else None


def partial_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level, resolved): the longest path to each node that no cycle leads to; nodes on or behind one aren't resolved and are one above the highest of their resolved predecessors, or 0. Edges have both ends in ``nodes``."""
    edges = edges.select("src", "dst").where("src <> dst")
    placed, left = _rounds(edges, nodes)
    above = edges.join(placed.select(F.col("node").alias("src"), "level"), "src").groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("level"))
    rest = left.join(above, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"), F.lit(False).alias("resolved"))
    return placed.select("node", "level", F.lit(True).alias("resolved")).unionByName(rest)


def settled_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): ``partial_levels``, where nodes that aren't resolved then go in the order of their names, each one more than the highest of its predecessors as these stand by then."""
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    levels = cut(partial_levels(links, nodes))
    stuck = levels.where("not resolved").select("node", "level")
    among = cut(links.join(stuck.select(F.col("node").alias("src"), F.col("level").alias("before")), "src").join(stuck.select(F.col("node").alias("dst")), "dst", "left_semi"))
    later = among.where("src > dst").groupBy(F.col("dst").alias("node")).agg((F.max("before") + 1).alias("l"))
    now, moved = cut(stuck.join(later, "node", "left").select("node", F.greatest("level", F.coalesce("l", "level")).alias("level"))), True
    while moved:
        step = among.where("src < dst").join(now.select(F.col("node").alias("src"), "level"), "src").groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("l"))
        now = cut(now.join(step, "node", "left").select("node", F.greatest("level", F.coalesce("l", "level")).alias("level"), F.coalesce(F.col("l") > F.col("level"), F.lit(False)).alias("moved")))
        moved, now = not now.where("moved").isEmpty(), now.select("node", "level")
    return levels.where("resolved").select("node", "level").unionByName(now)


def chains(edges: DataFrame, start, limit: int) -> DataFrame:
    """(path, ord): simple paths from ``start`` that cannot go on, in the order of a depth-first walk; ``limit`` at most.

    Nodes are of any type. (src, dst, ord) gives the order of a node's successors. Every open path ends in a chain or more, so of each round
    only the first ``limit`` paths in order can matter: that bounds the rounds' size.
    """
    spark, kind = edges.sparkSession, edges.schema["dst"].dataType.simpleString()
    paths = spark.createDataFrame([([start], [0], False)], f"path array<{kind}>, ord array<int>, done boolean")
    while True:
        opened = paths.where("not done")
        if opened.isEmpty():
            return paths.select("path", "ord").orderBy("ord").limit(limit)
        step = opened.join(edges, F.element_at(opened["path"], -1) == edges["src"], "left")
        usable = F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))
        step = step.withColumn("usable", F.coalesce(usable, F.lit(False)))
        onward = step.where("usable").select(F.array_append("path", F.col("dst")).alias("path"), F.array_append(opened["ord"], edges["ord"]).alias("ord"), F.lit(False).alias("done"))
        ended = step.groupBy("path", opened["ord"].alias("o")).agg(F.bool_or("usable").alias("any")).where("not any").select("path", F.col("o").alias("ord"), F.lit(True).alias("done"))
        paths = cut(paths.where("done").unionByName(ended).unionByName(onward).orderBy("ord").limit(limit))


def hierarchy(children: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, node, depth, cycle): the tree under ``roots`` (node) over (parent, child); a node on its own path is a leaf marked cycle."""
    level = cut(roots.select(F.array(F.col("node").cast("string")).alias("path"), F.col("node").cast("string").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("cycle")))
    out, link = level, children.select(F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child"))
    depth = 0
    while True:
        depth += 1
        nxt = level.where("not cycle").join(link, level["node"] == link["parent"]).select(F.array_append("path", F.col("child")).alias("path"), F.col("child").alias("node"), F.lit(depth).alias("depth"), F.array_contains("path", F.col("child")).alias("cycle"))
        level = cut(nxt)
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def unused(modules: DataFrame, instances: DataFrame) -> DataFrame:
    """(name) of modules (name) that nothing instantiates over (child)."""
    return modules.select("name").join(instances.select(F.col("child").alias("name")), "name", "left_anti")


def parents(children: DataFrame) -> DataFrame:
    """(child, parents, first_parent) of (parent, child): how many modules instantiate a module, however often, and the first by name."""
    return children.select("parent", "child").distinct().groupBy("child").agg(F.count("*").alias("parents"), F.min("parent").alias("first_parent"))


def infer_tops(modules: DataFrame, instances: DataFrame) -> DataFrame:
    """Names of (name, is_testbench) that no design module instantiates over (parent, child, parent_is_testbench).

    If there are none, those that nothing instantiates; else all design modules. Of these, the ones that instantiate
    something of the project, if any do.
    """
    design = modules.where("not is_testbench").select("name")
    a = design.join(instances.where("not parent_is_testbench").select(F.col("child").alias("name")), "name", "left_anti").withColumn("tier", F.lit(1))
    b = design.join(instances.select(F.col("child").alias("name")), "name", "left_anti").withColumn("tier", F.lit(2))
    tiers = a.unionByName(b).unionByName(design.withColumn("tier", F.lit(3)))
    best = tiers.where(F.col("tier") == tiers.agg(F.min("tier")).first()[0]).select("name")
    parents = instances.join(modules.select(F.col("name").alias("child")), "child", "left_semi").select(F.col("parent").alias("name"))
    inner = best.join(parents, "name", "left_semi")
    return best if inner.isEmpty() else inner


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, each named by its greatest node.

    Every round colours the nodes left with the greatest node that reaches them, and takes out, for each node that has
    its own colour, the nodes of this colour that reach it. Rounds end when no node is left.
    """
    left, edge, out = cut(nodes.select("node").distinct()), cut(edges.select("src", "dst").where("src <> dst").distinct()), None
    while not left.isEmpty():
        side = sides(left, edge)
        colour, moved = left.withColumn("colour", F.col("node")), True
        while moved:
            step = edge.join(side(colour.select(F.col("node").alias("src"), F.col("colour").alias("c"))), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("c"))
            colour = cut(colour.join(side(step), "node", "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") > F.col("colour")).alias("moved")))
            moved = not colour.where("moved").isEmpty()
            colour = colour.select("node", "colour")
        own = edge.join(side(colour.select(F.col("node").alias("src"), F.col("colour").alias("a"))), "src").join(side(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b"))), "dst").where("a = b").select("src", "dst")
        own = cut(own)
        found = frontier = cut(colour.where("node = colour").select("node", F.col("colour").alias("component")))
        while not frontier.isEmpty():
            new = frontier.join(side(own), frontier["node"] == own["dst"]).select(F.col("src").alias("node"), "component").distinct()
            frontier = cut(new.join(side(found), "node", "left_anti"))
            found = found.unionByName(frontier)
        found = cut(found)
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(side(found), "node", "left_anti"))
        edge = cut(edge.join(side(left.select(F.col("node").alias("src"))), "src", "left_semi").join(side(left.select(F.col("node").alias("dst"))), "dst", "left_semi"))
    return out if out is not None else left.withColumn("component", F.col("node"))
