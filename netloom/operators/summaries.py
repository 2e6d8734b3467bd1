"""Summaries and filters of a design's tables: files and their modules, ports and nets at a glance, what a view shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import SHOWN_CONTROLS, is_control_name


def modules_by_file(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, name, modules) of every file: the sorted names of its modules, empty for a file without any."""
    of = modules.groupBy("path").agg(F.array_sort(F.collect_list("module")).alias("modules"))
    none = F.array().cast("array<string>")
    return files.select("path").distinct().join(of, "path", "left").select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.coalesce("modules", none).alias("modules"))


def files_without_modules(files: DataFrame, modules: DataFrame) -> DataFrame:
    return files.select("path").distinct().join(modules.select("path"), "path", "left_anti")


def port_sides(ports: DataFrame, pins: DataFrame) -> DataFrame:
    """(node, inputs, outputs, others, longest, busiest) of (node, port, direction) and the connections (node, port): counts a side, the longest port name, the most connections of one port."""
    per = pins.groupBy("node", "port").agg(F.count("*").alias("n"))
    n = lambda c: F.count_if(c)
    d = F.col("direction")
    return ports.join(per, ["node", "port"], "left").groupBy("node").agg(
        n(d == "input").alias("inputs"), n(d == "output").alias("outputs"), n(~d.isin("input", "output") | d.isNull()).alias("others"), F.max(F.length("port")).alias("longest"), F.coalesce(F.max("n"), F.lit(0)).alias("busiest")
    )


def net_routes(ends: DataFrame) -> DataFrame:
    """(net, sources, sinks, class, width) of (net, node, role, ord, class, width): distinct nodes of either role by first appearance, and class and width of the first end; ends of one place come by node."""
    first = ends.groupBy("net", "node", "role").agg(F.min("ord").alias("ord"))
    nodes = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("ord", "node")))), lambda x: x["node"])
    sides = first.groupBy("net").agg(nodes("source").alias("sources"), nodes("sink").alias("sinks"))
    return sides.join(ends.groupBy("net").agg(F.min(F.struct("ord", "node", "class", "width")).alias("first")).select("net", "first.class", "first.width"), "net")


def region_boxes(blocks: DataFrame, margin: int = 20) -> DataFrame:
    """(region, x1, y1, x2, y2): the box around a region's blocks (region, x, y, width, height), with a margin."""
    return blocks.groupBy("region").agg(
        (F.min("x") - margin).alias("x1"), (F.min("y") - margin).alias("y1"), (F.max(F.col("x") + F.col("width")) + margin).alias("x2"), (F.max(F.col("y") + F.col("height")) + margin).alias("y2")
    )


def hops_kept(hops: DataFrame, keys: list[str], limit: int = 500) -> DataFrame:
    """(start, collected, kept, truncated): hops of each start in all, and distinct ones up to ``limit``; fewer kept than collected counts as truncated, also where only repeats went."""
    kept = F.least(F.lit(limit), F.count_distinct(F.struct(*keys)))
    return hops.groupBy("start").agg(F.count("*").alias("collected"), kept.alias("kept"), (F.count("*") > kept).alias("truncated"))


def matching_nodes(nodes: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Nodes one of whose ``fields`` contains the query, whatever the case; all for a blank one."""
    wanted = query.strip().lower()
    return nodes.where(F.contains(F.lower(F.concat_ws("\n", *fields)), F.lit(wanted))) if wanted else nodes


def naming(rows: DataFrame, terms: list[str], field: str) -> DataFrame:
    """Rows whose ``field`` contains one of the terms, whatever the case; all without terms."""
    hit = F.lit(not terms)
    for term in terms:
        hit = hit | F.contains(F.lower(field), F.lit(term.lower()))
    return rows.where(hit)


def known_edges(edges: DataFrame) -> DataFrame:
    """Edges whose flow is known."""
    return edges.where(F.coalesce(F.col("flow"), F.lit("unknown")) != "unknown")


def shown_edges(edges: DataFrame, mode: str) -> DataFrame:
    """Edges (net, width, fanout) of a schematic: all in full mode, buses in bus mode; in simplified mode buses, nets of several sinks, clocks, resets and handshakes."""
    bus = F.coalesce(F.col("width") > 1, F.lit(False))
    return edges.where({"full": F.lit(True), "bus": bus, "simplified": bus | (F.col("fanout") > 1) | F.lower("net").rlike("|".join(SHOWN_CONTROLS))}[mode])


def meaningful_hops(hops: DataFrame) -> DataFrame:
    """Hops (role, crosses) that compute or store something, or cross a module's border."""
    return hops.where(F.col("role").isin("compute", "pipeline") | F.coalesce("crosses", F.lit(False)))


def scopes(signals: DataFrame, query: str = "") -> DataFrame:
    """(scope, signals): sorted names of the signals of each scope, of those whose scope or name contains the query."""
    hit = F.contains(F.lower(F.concat_ws(".", "scope", "name")), F.lit(query.strip().lower()))
    return signals.where(hit).groupBy("scope").agg(F.array_sort(F.collect_list("name")).alias("signals"))


def net_stats(ends: DataFrame) -> DataFrame:
    """(net, ends, fanout, bit_width, is_bus, control) of each net: its ends, those that aren't sources only, the widest end, and whether its name is a control signal's."""
    control = is_control_name(F.col("net").cast("string"))
    return ends.groupBy("net").agg(F.count("*").alias("ends"), F.count_if(F.col("role") != "source").alias("fanout"), F.max("bit_width").alias("bit_width"), F.bool_or(F.col("bit_width") > 1).alias("is_bus")).withColumn("control", control)


def child_counts(modules: DataFrame, instances: DataFrame) -> DataFrame:
    """(module, children): the instances (parent, child) in each of ``modules`` (module) whose own module is among these."""
    inside = instances.join(modules.select(F.col("module").alias("child")), "child", "left_semi").groupBy(F.col("parent").alias("module")).agg(F.count("*").alias("n"))
    return modules.select("module").distinct().join(inside, "module", "left").select("module", F.coalesce("n", F.lit(0)).alias("children"))


def counts_by_kind(rows: DataFrame, group: str, kind: str, kinds: list) -> DataFrame:
    """(group, a column for each of ``kinds``): how many rows of each kind a group has."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(kind) == k).alias(str(k)) for k in kinds])


def newest(rows: DataFrame, group: str, by: list[str], most: int) -> DataFrame:
    """The ``most`` newest rows of each group by the columns ``by``, numbered in ``n`` from 1, for listings; older ones are left out.

    Spark drops what cannot be among a group's first rows before the shuffle.
    """
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in by]))).where(F.col("n") <= most)
