"""Connectivity and signal traces over the tables of a design catalog (see ``netloom.sources.rtl``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import endpoint_role, signal_reference
from netloom.sources import rtl

from .graphs import apart, cut

TABLES = ["modules", "ports", "signals", "assigns", "gates", "instances", "pins", "always_blocks", "always_assigns"]


def catalog(mods: DataFrame) -> dict[str, DataFrame]:
    """All tables of ``rtl.modules``. Of modules with one name the first by (path, order) counts, as in a hierarchy.

    The modules are written to the shared folder once, since all tables read them.
    """
    first = mods.withColumn("__n", F.row_number().over(Window.partitionBy("module").orderBy("path", "mod_ord"))).where("__n = 1").drop("__n")
    first = cut(first)
    insts, blocks = rtl.instances(first), rtl.always_blocks(first)
    return {
        "modules": first.select("path", "mod_ord", "module", "line"), "ports": rtl.ports(first), "signals": rtl.signals(first), "assigns": rtl.assigns(first), "gates": rtl.gates(first),
        "instances": insts, "pins": rtl.pins(insts), "always_blocks": blocks, "always_assigns": rtl.always_assigns(blocks),
    }


def known_names(tables: dict) -> DataFrame:
    """(module, name): ports and declared signals, what dependencies can name."""
    return tables["ports"].select("module", "name").unionByName(tables["signals"].select("module", "name")).distinct()


def _base(text) -> F.Column:
    return F.coalesce(signal_reference(text)["base"], F.trim(text))


def endpoints(tables: dict) -> DataFrame:
    """(module, net, node, port, role, bit_width, is_bus): what is attached to each net of each module.

    Ports are nodes ``io:``, seen from inside the module; instances, gates, assigns and always blocks are nodes of their
    kind. A pin of a module that isn't in the catalog, or by position, has the role unknown. An open pin has a net of its
    own. Signals that a block both reads and writes are bidirectional. Where a net is declared as a signal, its width holds.
    """
    out = lambda df, net, node, port, role, width=F.lit(1), bus=F.lit(False): df.select("module", net.alias("net"), node.alias("node"), port.alias("port"), role.alias("role"), width.alias("bit_width"), bus.alias("is_bus"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    c = F.col
    inside = F.when(c("direction") == "input", "source").when(c("direction") == "output", "sink").otherwise(endpoint_role(c("direction")))
    io = out(tables["ports"], c("name"), text("io:", c("name")), c("name"), inside, c("bit_width"), c("is_bus"))
    child = tables["ports"].select(c("module").alias("child"), c("name").alias("child_port"), "direction", "bit_width", "is_bus")
    pins = tables["pins"].join(apart(child), ["child", "child_port"], "left")
    net = F.when(c("parent_signal") == "", text("__open__:", c("instance"), ".", c("child_port"))).otherwise(_base(c("parent_signal")))
    inst = out(pins, net, text("instance:", c("instance")), c("child_port"), endpoint_role(c("direction")), F.coalesce("bit_width", F.lit(1)), F.coalesce("is_bus", F.lit(False)))
    g = tables["gates"].select("*", text("gate:", c("name")).alias("node"))
    gates = out(g, _base(c("output")), c("node"), F.lit("out"), F.lit("source")).unionByName(out(g.select("module", "node", F.explode("inputs").alias("i")), _base(c("i")), c("node"), F.lit("in"), F.lit("sink")))
    a = tables["assigns"].select("*", text("assign:", c("idx").cast("string"), ":", c("target")).alias("node"))
    reads = a.select("module", "node", F.explode("sources").alias("name")).join(apart(known_names(tables)), ["module", "name"], "left_semi")
    assigns = out(a, _base(c("target")), c("node"), F.lit("target"), F.lit("source")).unionByName(out(reads, c("name"), c("node"), c("name"), F.lit("sink")))
    steps = tables["always_assigns"].select("module", text("always:", c("block").cast("string")).alias("node"), "target", F.array_union("sources", "condition_signals").alias("reads"))
    clocks = tables["always_blocks"].select("module", text("always:", c("ord").cast("string")).alias("node"), F.explode(rtl.identifiers(c("sensitivity"))).alias("name"), F.lit("read").alias("use"))
    used = steps.select("module", "node", _base(c("target")).alias("name"), F.lit("write").alias("use")).unionByName(steps.select("module", "node", F.explode("reads").alias("name"), F.lit("read").alias("use"))).unionByName(clocks)
    roles = used.join(apart(known_names(tables)), ["module", "name"], "left_semi").groupBy("module", "node", "name").agg(F.bool_or(c("use") == "read").alias("r"), F.bool_or(c("use") == "write").alias("w"))
    always = out(roles, c("name"), c("node"), c("name"), F.when(c("r") & c("w"), "bidir").when(c("w"), "source").otherwise("sink"))
    ends = io.unionByName(inst).unionByName(gates).unionByName(assigns).unionByName(always)
    declared = tables["signals"].select("module", c("name").alias("net"), c("bit_width").alias("w"), c("is_bus").alias("b")).dropDuplicates(["module", "net"])
    wide = ends.join(apart(declared), ["module", "net"], "left").withColumns({"bit_width": F.coalesce("w", "bit_width"), "is_bus": F.coalesce("b", F.lit(False)) | c("is_bus")})
    return wide.select(*ends.columns)


def connectivity(ends: DataFrame, all_pairs: bool = False) -> DataFrame:
    """(module, net, src, dst, flow, bit_width, is_bus): sources to sinks of each net of each module.

    On nets that lack sources or sinks, a row for each node but the first by (node, port), from the first, with flow
    ``unknown``: that links the same nodes as all their pairs do, in rows that grow with the net and not with its square.
    With ``all_pairs``, a row for each two of their nodes, the first by name as ``src``. ``ends`` are written once, since
    each side of the joins would find them again.
    """
    ends, key = cut(ends), ["module", "net"]
    sides = ends.groupBy(key).agg(F.bool_or(F.col("role").isin("source", "bidir")).alias("s"), F.bool_or(F.col("role").isin("sink", "bidir")).alias("k"), F.max("bit_width").alias("bit_width"), F.bool_or("is_bus").alias("is_bus"), F.min(F.struct("node", "port")).alias("first"))
    src = ends.where(F.col("role").isin("source", "bidir")).select(*key, F.col("node").alias("src")).distinct()
    dst = ends.where(F.col("role").isin("sink", "bidir")).select(*key, F.col("node").alias("dst")).distinct()
    directed = src.join(apart(dst), key).where("src <> dst").join(apart(sides.select(*key, "bit_width", "is_bus")), key).withColumn("flow", F.lit("directed"))
    loose = ends.select(*key, F.col("node").alias("dst")).distinct().join(apart(sides.where(~(F.col("s") & F.col("k")))), key)
    if all_pairs:
        loose = loose.join(apart(ends.select(*key, F.col("node").alias("src")).distinct()), key).where("src < dst")
    else:
        loose = loose.withColumn("src", F.col("first.node")).where("src <> dst")
    unknown = loose.select(*key, "src", "dst", "bit_width", "is_bus", F.lit("unknown").alias("flow"))
    return directed.unionByName(unknown)


def hops(tables: dict) -> DataFrame:
    """(module, target, next_module, source, kind, dep): each way in which a signal depends on another, of all signals.

    Within a module through assigns, gates and always blocks (dep data, control or both); down through output pins of an
    instance into its module; up through an input port to every pin that any parent connects to it. Targets and sources
    are base names. Trace with ``netloom.operators.graphs.reachable``, or in the other direction with the columns swapped.
    """
    c = F.col
    row = lambda df, target, source, kind, dep="data", nxt=c("module"): df.select("module", target.alias("target"), nxt.alias("next_module"), source.alias("source"), F.lit(kind).alias("kind"), (dep if not isinstance(dep, str) else F.lit(dep)).alias("dep"))
    assigns = row(tables["assigns"].select("module", _base(c("target")).alias("t"), "sources").select("module", "t", F.explode("sources").alias("s")), c("t"), c("s"), "assign")
    steps = tables["always_assigns"].select("module", _base(c("target")).alias("t"), "sources", "condition_signals").select("*", F.explode(F.array_union("sources", "condition_signals")).alias("s"))
    data, control = F.array_contains("sources", c("s")), F.array_contains("condition_signals", c("s"))
    always = row(steps, c("t"), c("s"), "always", F.when(data & control, "data+control").when(data, "data").otherwise("control"))
    gates = row(tables["gates"].select("module", _base(c("output")).alias("t"), "inputs").select("module", "t", F.explode("inputs").alias("i")).select("module", "t", _base(c("i")).alias("s")), c("t"), c("s"), "gate")
    child = tables["ports"].select(c("module").alias("child"), c("name").alias("child_port"), "direction")
    pins = tables["pins"].where("parent_signal <> ''").join(apart(child), ["child", "child_port"]).withColumn("base", signal_reference(c("parent_signal"))["base"])
    pins = pins.withColumn("s", F.explode(F.when(c("base").isNotNull(), F.array("base")).otherwise(rtl.identifiers(c("parent_signal")))))
    down = row(pins.where(c("direction").isin("output", "inout")), c("s"), c("child_port"), "instance", nxt=c("child"))
    ups = pins.where(c("direction").isin("input", "inout")).select(c("child").alias("module"), c("child_port").alias("t"), "s", c("module").alias("parent"))
    up = row(ups, c("t"), c("s"), "port", nxt=c("parent"))
    known = known_names(tables)
    inner = assigns.unionByName(always).unionByName(gates).join(apart(known.withColumnRenamed("name", "source")), ["module", "source"], "left_semi").select(*down.columns)
    return inner.unionByName(down).unionByName(up).distinct()


def block_summaries(tables: dict) -> DataFrame:
    """(module, block, control_summary, summary_lines, written, read) of each always block.

    Up to 6 outer ifs, cases and assignments; up to 8 distinct assignments with their innermost conditions; the known
    names in targets, those of index expressions included; and the known names in expressions, innermost conditions and
    the control summary. All in the order in which they first appear.
    """
    known = known_names(tables).groupBy("module").agg(F.collect_list("name").alias("known"))
    blocks = tables["always_blocks"].select("module", F.col("ord").alias("block"), "steps", F.slice("controls", 1, 6).alias("control_summary")).join(apart(known), "module", "left")
    line = lambda s: F.concat(s["target"], F.when(s["blocking"], " = ").otherwise(" <= "), s["expression"], F.when(s["condition"] != "", F.concat(F.lit(" when "), s["condition"])).otherwise(""))
    of = lambda *texts: F.array_distinct(F.array_intersect(rtl.identifiers(F.concat_ws(" ", *texts)), F.coalesce("known", F.array().cast("array<string>"))))
    each = lambda f: F.concat_ws(" ", F.transform("steps", f))
    return blocks.select(
        "module", "block", "control_summary", F.slice(F.array_distinct(F.transform("steps", line)), 1, 8).alias("summary_lines"),
        of(each(lambda s: s["target"])).alias("written"), of(each(lambda s: F.concat_ws(" ", s["expression"], s["condition"])), F.concat_ws(" ", "control_summary")).alias("read"),
    )


def hop_edges(found: DataFrame) -> DataFrame:
    """``hops`` as (src, dst) from a signal, named module.signal, to what it depends on."""
    return found.select(F.concat_ws(".", "module", "target").alias("src"), F.concat_ws(".", "next_module", "source").alias("dst")).distinct()


def children(tables: dict) -> DataFrame:
    """(parent, child) of each instance, for ``graphs.hierarchy`` and ``graphs.infer_tops``."""
    return tables["instances"].select(F.col("module").alias("parent"), "child")


def refreshed(old: DataFrame, new: DataFrame) -> DataFrame:
    """A catalog table with the rows of ``new`` in place of those of the same files; files of ``new`` that weren't there are added.

    Both have ``path``. For deciding whether names changed, see ``changed_modules``.
    """
    return old.join(apart(new.select("path").distinct()), "path", "left_anti").unionByName(new)


def changed_modules(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, module, change): modules lost and added in the files of ``new``; none means that replacing rows is enough."""
    mine, theirs = old.join(apart(new.select("path").distinct()), "path", "left_semi").select("path", "module"), new.select("path", "module")
    return mine.exceptAll(theirs).withColumn("change", F.lit("lost")).unionByName(theirs.exceptAll(mine).withColumn("change", F.lit("added")))


def stale(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files whose (path, size, modified) isn't among the signatures already extracted."""
    return files.join(apart(known.select("path", "size", "modified").distinct()), ["path", "size", "modified"], "left_anti")
