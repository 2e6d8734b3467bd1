"""Graphs of a design catalog to look at: nets as nodes, ports as nodes, merged edges, instance trees, traces of a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import signal_reference
from netloom.sources import rtl

from .graphs import apart, cut

c = F.col


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def port_view(ends: DataFrame) -> DataFrame:
    """``design.endpoints`` with each pin of an instance and each signal of an always block as a node of its own."""
    side = F.when(c("role") == "bidir", "inout").when(c("role") == "source", "output").otherwise("input")
    pin = _text("instance_port:", F.substring_index("node", "instance:", -1), ".", c("port"))
    process = _text("process_port:", F.substring_index("node", "always:", -1), ":", side, ":", c("port"))
    return ends.withColumn("node", F.when(c("node").startswith("instance:"), pin).when(c("node").startswith("always:"), process).otherwise(c("node")))


def net_graph(ends: DataFrame) -> DataFrame:
    """(module, net, src, dst, port, flow): each net is a node ``net:``, fed by its sources and feeding its sinks.

    Bidirectional ends do both; ends of an unknown role hang on the net with flow ``unknown``.
    """
    net = _text("net:", c("net"))
    into = F.struct(c("node").alias("src"), net.alias("dst"), F.lit("directed").alias("flow"))
    out = lambda flow: F.struct(net.alias("src"), c("node").alias("dst"), F.lit(flow).alias("flow"))
    ways = F.when(c("role") == "source", F.array(into)).when(c("role") == "sink", F.array(out("directed"))).when(c("role") == "bidir", F.array(into, out("directed"))).otherwise(F.array(out("unknown")))
    return ends.select("module", "net", "port", F.explode(ways).alias("e")).select("module", "net", "e.src", "e.dst", "port", "e.flow")


def aggregated(edges: DataFrame) -> DataFrame:
    """``design.connectivity`` with one row for each (module, src, dst, flow).

    nets, bus_nets and wire_nets are sorted; bit_width is the widest; sig_class is bus, wire or mixed; net is null
    unless it is the only one.
    """
    each = edges.groupBy("module", "src", "dst", "flow", "net").agg(F.max("bit_width").alias("bit_width"), F.bool_or("is_bus").alias("is_bus"))
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, c("net"))))
    bus, wire = F.count_if(c("is_bus")), F.count_if(~c("is_bus"))
    return each.groupBy("module", "src", "dst", "flow").agg(
        names(F.lit(True)).alias("nets"), names(c("is_bus")).alias("bus_nets"), names(~c("is_bus")).alias("wire_nets"), F.max("bit_width").alias("bit_width"),
        F.count("*").alias("net_count"), F.when(wire == 0, "bus").when(bus == 0, "wire").otherwise("mixed").alias("sig_class"),
        F.when(F.count("*") == 1, F.min("net")).alias("net"),
    )


def missing_pins(tables: dict) -> DataFrame:
    """(module, instance, child, child_port, direction, open): ports of instances that nothing is connected to.

    ``open`` tells those with empty brackets from those that aren't listed. Instances connected by position are left out,
    and so are those of modules outside the catalog.
    """
    pins = tables["pins"]
    ports = tables["ports"].select(c("module").alias("child"), c("name").alias("child_port"), "direction")
    insts = tables["instances"].select("module", c("name").alias("instance"), "child")
    placed = insts.join(apart(pins.where(c("child_port").rlike(r"^arg\d+$")).select("module", "instance")), ["module", "instance"], "left_anti")
    used = pins.groupBy("module", "instance", "child_port").agg(F.bool_and(c("parent_signal") == "").alias("open"))
    all_ = placed.join(apart(ports), "child").join(apart(used), ["module", "instance", "child_port"], "left")
    return all_.where("open IS NULL OR open").select("module", "instance", "child", "child_port", "direction", c("open").isNotNull().alias("open"))


def instance_tree(tables: dict, tops: DataFrame) -> DataFrame:
    """(path, module, instance, parent, depth, cycle, resolved) under ``tops`` (node), one row for each place of a module.

    A path is the top's name, then /instance:module for each level. A module that is on its own path already has cycle
    and is not opened; one outside the catalog is not resolved.
    """
    known = tables["modules"].select("module", F.lit(True).alias("resolved"))
    link = tables["instances"].select(c("module").alias("m"), c("name").alias("i"), "child")
    none = F.lit(None).cast("string")
    level = tops.select(c("node").alias("path"), c("node").alias("module"), none.alias("instance"), none.alias("parent"), F.lit(0).alias("depth"), F.lit(False).alias("cycle"), F.array("node").alias("active"))
    out, depth = None, 0
    while True:
        depth += 1
        level = cut(level.join(apart(known), "module", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False))))
        out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            break
        level = level.where("resolved AND NOT cycle").join(apart(link), c("module") == c("m")).select(
            _text(c("path"), "/", c("i"), ":", c("child")).alias("path"), c("child").alias("module"), c("i").alias("instance"), c("path").alias("parent"),
            F.lit(depth).alias("depth"), F.array_contains("active", c("child")).alias("cycle"), F.array_append("active", c("child")).alias("active"),
        )
    return out.drop("active")


def hierarchy_graph(tables: dict, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind) and edges (src, dst, kind) of an ``instance_tree``: modules, instances, ports and nets.

    Edges are ``hierarchy`` from the outer to the inner, and ``signal`` from a module's port to its net and from a net to
    the pins on it. Nets that are used but not declared are nodes too; an open pin has a net of its own.
    """
    place = tree.where("resolved").select("path", "module", "cycle")
    module = _text("module:", c("path"))
    net = lambda name: _text("net:", c("path"), ":", name)
    node = lambda df, i, label, kind: df.select(i.alias("id"), label.alias("label"), F.lit(kind).alias("kind"))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    ports = place.join(apart(tables["ports"].select("module", "name", "direction")), "module")
    port = _text("port:", c("path"), ":", c("name"))
    signals = place.join(apart(tables["signals"].select("module", "name")), "module")
    inner = tree.where("parent IS NOT NULL").select(c("path").alias("child_path"), c("module").alias("child"), c("instance").alias("name"), c("parent").alias("path"))
    inst = _text("instance:", c("path"), "/", c("name"))
    pins = place.where("NOT cycle").join(apart(tables["pins"].select("module", c("instance").alias("name"), "child_port", "parent_signal")), "module")
    known = tables["ports"].select("module", c("name").alias("base")).unionByName(tables["signals"].select("module", c("name").alias("base"))).distinct().withColumn("known", F.lit(True))
    based = pins.withColumn("base", signal_reference(c("parent_signal"))["base"]).join(apart(known), ["module", "base"], "left")
    used = F.when(c("parent_signal") == "", _text("__open__:", c("name"), ".", c("child_port"))).when(c("known"), c("base")).otherwise(c("parent_signal"))
    based = based.withColumn("net", used)
    pin = _text("port:", inst, ":", c("child_port"))
    implied = based.where("known IS NULL").select("path", "net").distinct()
    nodes = node(tree, module, c("module"), "module").unionByName(node(inner, inst, _text(c("name"), ": ", c("child")), "instance"))
    nodes = nodes.unionByName(node(ports, port, _text(c("name"), " (", c("direction"), ")"), "port")).unionByName(node(ports.select("path", "name").unionByName(signals.select("path", "name")).distinct(), net(c("name")), c("name"), "net"))
    nodes = nodes.unionByName(node(pins, pin, _text(c("name"), ".", c("child_port")), "port")).unionByName(node(implied, net(c("net")), c("net"), "net"))
    edges = edge(inner, module, inst, "hierarchy").unionByName(edge(inner, inst, _text("module:", c("child_path")), "hierarchy")).unionByName(edge(ports, module, port, "hierarchy"))
    edges = edges.unionByName(edge(ports, port, net(c("name")), "signal")).unionByName(edge(signals, module, net(c("name")), "hierarchy")).unionByName(edge(pins, inst, pin, "hierarchy"))
    edges = edges.unionByName(edge(implied, module, net(c("net")), "hierarchy")).unionByName(edge(based, net(c("net")), pin, "signal"))
    return nodes.distinct(), edges.distinct()


def trace(hops: DataFrame, module: str, signal: str, most: int = 500) -> DataFrame:
    """(direction, id, module, signal, next_module, next_signal, kind, dep): the first ``most`` hops each way of one signal.

    fanin goes to what it depends on, fanout to what depends on it; ids count from 0 each way, by kind, module and
    signal. A direction without hops has one row of kind dead_end.
    """
    at = lambda m, s: (c(m) == module) & (c(s) == F.regexp_replace(F.trim(F.lit(signal)), r"\s+", " "))
    row = lambda df, way, m, s, nm, ns: df.select(F.lit(way).alias("direction"), c(m).alias("module"), c(s).alias("signal"), c(nm).alias("next_module"), c(ns).alias("next_signal"), "kind", "dep")
    back = row(hops.where(at("module", "target")), "fanin", "module", "target", "next_module", "source")
    forth = row(hops.where(at("next_module", "source")), "fanout", "next_module", "source", "module", "target")
    rank = Window.partitionBy("direction").orderBy("kind", "next_module", "next_signal", "dep")
    found = back.unionByName(forth).distinct().withColumn("id", F.row_number().over(rank) - 1).where(c("id") < max(1, most))
    none = F.lit(None).cast("string")
    ways = hops.sparkSession.createDataFrame([("fanin",), ("fanout",)], "direction string").join(apart(found.select("direction").distinct()), "direction", "left_anti")
    ends = ways.select("direction", F.lit(module).alias("module"), F.lit(signal).alias("signal"), none.alias("next_module"), none.alias("next_signal"), F.lit("dead_end").alias("kind"), F.lit("data").alias("dep"), F.lit(0).alias("id"))
    return found.unionByName(ends).select("direction", "id", "module", "signal", "next_module", "next_signal", "kind", "dep")


def unresolved(tables: dict) -> DataFrame:
    """(module, signal, instance, child): where a trace leaves the catalog, at pins of modules that it doesn't have."""
    pins = tables["pins"].where("parent_signal <> ''").join(apart(tables["modules"].select(c("module").alias("child"))), "child", "left_anti")
    base = signal_reference(c("parent_signal"))["base"]
    names = F.when(base.isNotNull(), F.array(base)).otherwise(rtl.identifiers(c("parent_signal")))
    return pins.select("module", F.explode(names).alias("signal"), "instance", "child").distinct()


def with_instance(files: DataFrame, tables: dict, parent: str, child: str, name: str | None = None) -> DataFrame:
    """(path, text) of the file of module ``parent``, with an instance of ``child``, all pins open, before its last endmodule.

    Without a ``name`` it is <child>_inst, with a number if the parent has that already. Raises ValueError if either
    module is unknown, or the name is none. The caller writes the text.
    """
    have = {r[0]: r[1] for r in tables["modules"].where(c("module").isin(parent, child)).select("module", "path").collect()}
    if parent not in have or child not in have:
        raise ValueError(f"no such module: {parent if parent not in have else child}")
    if name is None:
        taken = {r[0] for r in tables["instances"].where(c("module") == parent).select("name").collect()}
        base, k = f"{child.lower()}_inst", 0
        while (name := base + (str(k) if k else "")) in taken:
            k += 1
    valid_name(name)
    pins = [r[0] for r in tables["ports"].where(c("module") == child).orderBy("ord").select("name").collect()]
    body = ",\n".join(f"    .{p}()" for p in pins)
    snippet = f"\n  {child} {name} (\n{body}\n  );\n\n"
    file = files.where(c("path") == have[parent])
    before = F.regexp_extract("text", r"(?s)^(.*)endmodule", 1)
    return file.select("path", F.concat(before, F.lit(snippet), F.substr("text", F.length(before) + 1)).alias("text"))


def valid_name(name: str) -> str:
    """``name`` if it can name a module or instance; else ValueError."""
    import re

    if not re.fullmatch(rtl.ID, name) or name in rtl.RESERVED:
        raise ValueError(f"not a name: {name!r}")
    return name


def new_module(tables: dict, name: str) -> str:
    """The text of an empty module of a name that the catalog doesn't have; else ValueError."""
    if not tables["modules"].where(c("module") == valid_name(name)).isEmpty():
        raise ValueError(f"there is a module {name} already")
    return f"module {name} (\n\n);\n\n\nendmodule\n"
