"""Traces of signals: direct hops in the order of the source, the chains that they form, and the steps that a reader takes.

A trace answers for many signals at once. Fan-in goes to what drives a signal, fan-out to what reads it; a hop leads to
states (module, signal), where the next hops start. Names are compared as they are written, but a target or a pin with one
selection also counts for its base name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import expression_class, hop_role, is_noise
from netloom.sources import rtl

from .design import known_names
from .graphs import apart, cut, tasks
from .timeline import first_seen, islands

STATE = "struct<module:string,signal:string>"
AT = ["direction", "module", "signal"]
START = ["start_module", "start_signal", "direction"]
# what two hops of a signal must share to be one
SAME = ["kind", "label", "detail", "target", "dep", "next_module", "next_signal", "block_name", "style", "condition", "path", "line"]
REST = ["expression", "blocking", "instance", "crosses", "states"]
TYPES = {"line": "int", "blocking": "boolean", "states": f"array<{STATE}>"}
FIELDS = ["module", "signal", "kind", "role", "op_category", "expression", "label", "detail", "block_name", "style", "blocking", "condition", "dep", "target", "instance", "crosses", "next_module", "next_signal", "resolved", "path", "line"]
c = F.col


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _keys(name):
    """A name and, of one with a selection, what stands before it."""
    return F.array_distinct(F.array(name, F.trim(F.substring_index(name, "[", 1))))


def _states(module, names):
    return F.transform(F.filter(F.array_distinct(names), lambda n: ~is_noise(n)), lambda n: F.struct(module.alias("module"), n.alias("signal")))


def _hops(df: DataFrame, direction: str, module, signal, kind: str, order: list, **values) -> DataFrame:
    """Hops of a kind; ``order`` is (path of a parent or '', three numbers)."""
    rank = ["assign", "always", "gate", "instance_pin", "module_port"].index(kind.removesuffix("_in").removesuffix("_out"))
    place = F.struct(F.lit(rank).alias("rank"), order[0].alias("file"), *[x.cast("int").alias(f"n{k}") for k, x in enumerate(order[1:])])
    other = [values.get(n, F.lit(None)).cast(TYPES.get(n, "string")).alias(n) for n in SAME[1:] + REST]
    return df.select(F.lit(direction).alias("direction"), module.alias("module"), signal.alias("signal"), F.lit(kind).alias("kind"), *other, place.alias("place"))


def hops(tables: dict) -> DataFrame:
    """All hops of all signals both ways, with repeats: assigns, always blocks, gates, pins of instances, then pins that parents connect to a port.

    Sources are the known names of an expression. Pins of modules that the catalog doesn't have are hops both ways.
    """
    zero, here = F.lit(0), F.lit("")
    known = known_names(tables).groupBy("module").agg(F.collect_list("name").alias("known"))
    of = lambda names: F.array_intersect(names, F.coalesce("known", F.array().cast("array<string>")))
    out = []

    def local(df, kind, order, target, fans_in, fans_out, back, **values):
        """Hops of what one statement drives and reads; ``fans_out`` pairs a name with its dep."""
        module = c("module")
        out.append(_hops(df.withColumn("key", F.explode(fans_in)), "fanin", module, c("key"), kind, order, states=_states(module, back), **values))
        reads = df.withColumn("read", F.explode(fans_out))
        values = values | {"dep": c("read.dep"), "target": target}
        out.append(_hops(reads, "fanout", module, c("read.name"), kind, order, states=_states(module, F.array(target)), **values))

    a = tables["assigns"].join(apart(known), "module", "left").withColumn("sources", of(c("sources")))
    reads = F.transform("sources", lambda n: F.struct(n.alias("name"), F.lit("data").alias("dep")))
    detail = F.trim(_text(c("target"), " = ", c("expression")))
    local(a, "assign", [here, c("idx"), c("pos"), zero], c("target"), _keys(c("target")), reads, c("sources"), label=_text("assign ", c("target")), detail=detail, expression=c("expression"), dep=F.lit("data"), path=c("path"), line=c("line"))

    number = F.row_number().over(Window.partitionBy("module").orderBy("ord")) - 1
    blocks = tables["always_blocks"].select("module", c("ord").alias("block"), "keyword", number.cast("string").alias("number"))
    s = tables["always_assigns"].join(apart(blocks), ["module", "block"]).join(apart(known), "module", "left")
    s = s.withColumns({"sources": of(c("sources")), "condition_signals": of(c("condition_signals")), "name": _text(c("keyword"), "_", c("number"))})
    both = F.array_union("sources", "condition_signals")
    dep = lambda data, control: F.when(data & control, "data+control").when(control, "control").otherwise("data")
    reads = F.transform(both, lambda n: F.struct(n.alias("name"), dep(F.array_contains("sources", n), F.array_contains("condition_signals", n)).alias("dep")))
    detail = F.trim(_text(c("target"), F.when(c("blocking"), " = ").otherwise(" <= "), c("expression")))
    local(
        s, "always", [here, c("block"), c("ord"), zero], c("target"), _keys(c("target")), reads, both, label=_text(c("keyword"), " ", c("name")), detail=detail, expression=c("expression"),
        dep=dep(F.size("sources") > 0, F.size("condition_signals") > 0), block_name=c("name"), style=c("style"), blocking=c("blocking"), condition=F.coalesce("condition", F.lit("")), path=c("path"), line=c("line"),
    )

    joined = F.array_join("inputs", ", ")
    reads = F.transform(F.array_distinct("inputs"), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("dep")))
    local(tables["gates"], "gate", [here, c("ord"), c("line"), zero], c("output"), F.array("output"), reads, c("inputs"), label=_text(c("gate_type"), " ", c("name")), detail=_text(c("output"), " <- ", joined), expression=joined, path=c("path"), line=c("line"))

    pins = tables["instances"].select("path", "module", "ord", "line", c("name").alias("instance"), "child", F.posexplode("connections").alias("pin", "p")).select("*", "p.port", F.regexp_replace("p.value", rf"^({rtl.ID})\s*\[[^\]]*\]\s*$", "$1").alias("net")).drop("p")
    pins = pins.where(~is_noise(c("net")))
    directions = tables["ports"].groupBy(c("module").alias("child"), c("name").alias("port")).agg(F.min_by("direction", "ord").alias("way"))
    mods = tables["modules"].select(c("module").alias("child"), F.lit(True).alias("have"))
    pins = pins.join(apart(mods), "child", "left").join(apart(directions), ["child", "port"], "left").join(apart(tables["modules"].select("module", "mod_ord")), "module")
    state = lambda module, signal: F.array(F.struct(module.alias("module"), signal.alias("signal")))
    for direction, kind, ways, word in (("fanin", "out", ("output", "inout"), "from "), ("fanout", "in", ("input", "inout"), "to ")):
        down = pins.where(c("have").isNull() | c("way").isin(*ways))
        out.append(_hops(
            down, direction, c("module"), c("net"), f"instance_pin_{kind}", [here, c("ord"), c("pin"), zero], label=_text(c("instance"), ".", c("port")), detail=_text(word, c("child"), ".", c("port")), instance=c("instance"),
            crosses=F.lit("down"), next_module=c("child"), next_signal=c("port"), states=state(c("child"), c("port")), path=c("path"), line=c("line"),
        ))
        # a port's parents: its inputs when going back, its outputs when going forth
        back = ("input", "inout") if direction == "fanin" else ("output", "inout")
        up = pins.where(c("way").isin(*back))
        out.append(_hops(
            up, direction, c("child"), c("port"), "module_port_in" if direction == "fanin" else "module_port_out", [c("path"), c("mod_ord"), c("ord"), c("pin")], label=_text(c("module"), ".", c("instance")), detail=_text("↑ ", c("module"), ".", c("net")),
            expression=here, instance=c("instance"), crosses=F.lit("up"), next_module=c("module"), next_signal=c("net"), states=state(c("module"), c("net")), path=c("path"), line=c("line"),
        ))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _direct(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` distinct hops of each state (direction, module, signal), numbered: (AT, id, truncated, SAME, rest).

    truncated: fewer than there are, repeats included. One shuffle by state serves the grouping and the numbers.
    """
    one = found.repartition(tasks(found.sparkSession), *AT).groupBy(*AT, *SAME).agg(F.min_by(F.struct(*REST), "place").alias("rest"), F.min("place").alias("place"), F.count("*").alias("n"))
    of = Window.partitionBy(*AT)
    numbered = one.withColumns({"id": F.row_number().over(of.orderBy("place")) - 1, "truncated": F.sum("n").over(of) > F.least(F.count("*").over(of), F.lit(most))})
    return numbered.where(c("id") < most).select(*AT, "id", "truncated", *SAME, "rest.*")


def _told(asked: DataFrame, direct: DataFrame, modules: DataFrame) -> DataFrame:
    """``asked`` (START, chain, pos, truncated, AT, id) with the fields of their hops; one of kind dead_end where a state has none."""
    of = modules.select("module", c("path").alias("file"), c("line").alias("first"), F.lit(True).alias("resolved"))
    rows = asked.join(apart(of), "module", "left").join(apart(direct.drop("truncated", "states")), [*AT, "id"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    dead = c("kind").isNull()
    label = F.when(c("resolved"), _text("dead end: ", c("signal"))).otherwise(_text("module not found: ", c("module")))
    detail = F.when(c("resolved"), _text("No ", c("direction"), " connections found")).otherwise(_text("Module '", c("module"), "' is not in the project"))
    instead = {"kind": F.lit("dead_end"), "label": label, "detail": detail, "path": c("file"), "line": c("first"), "expression": F.lit("")}
    rows = rows.withColumns({n: F.when(dead, v).otherwise(c(n)) for n, v in instead.items()})
    rows = rows.withColumns({"role": hop_role(c("kind"), c("style"), c("blocking")), "op_category": expression_class(c("expression"))})
    return rows.select(*START, "chain", "pos", "truncated", "id", *FIELDS)


def trace(tables: dict, origins: DataFrame, most: int = 500) -> DataFrame:
    """Hops and chains of all ``origins`` (module, signal): (start_module, start_signal, direction, chain, pos, id, truncated, and the fields of a hop).

    Direct hops have no chain. A chain is a way on from the origin that comes to no state twice, up to where it cannot go
    on; chains are numbered in the order of a depth-first walk, ``most`` at most for each origin and direction. Each
    way that is still open ends in a chain or more, so no round needs more than the first ``most`` ways of an origin.
    Rounds carry states and the numbers of their hops only; what a hop says is joined once, at the end.
    """
    most = max(1, most)
    direct, modules = cut(_direct(hops(tables), most)), tables["modules"]
    light = direct.select(*AT, "id", "truncated", "states")
    none, number = F.lit(None).cast("int"), F.coalesce("id", F.lit(0))
    signal = F.regexp_replace(F.trim("signal"), r"\s+", " ")
    starts = origins.select(c("module").alias("start_module"), signal.alias("start_signal"), c("module"), signal.alias("signal")).where("module IS NOT NULL AND signal IS NOT NULL").distinct()
    starts = cut(starts.withColumn("direction", F.explode(F.array(F.lit("fanin"), F.lit("fanout")))))
    at = starts.join(apart(light), AT, "left").select(*START, none.alias("chain"), none.alias("pos"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "module", "signal", number.alias("id"))
    ways = starts.select(*START, "module", "signal", F.array(F.struct("module", "signal")).alias("seen"), F.array().cast("array<int>").alias("ord"))
    chains = None
    while True:
        fresh = F.filter(F.coalesce("states", F.array().cast(TYPES["states"])), lambda s: ~F.array_contains("seen", s))
        step = ways.join(apart(light), AT, "left").withColumns({"fresh": fresh, "id": number})
        ended = F.size("fresh") == 0
        nexts = F.when(ended, F.array(F.lit(None).cast(STATE))).otherwise(c("fresh"))
        step = step.select(*START, "seen", "ord", "id", ended.alias("done"), F.posexplode(nexts).alias("k", "to"))
        moved = step.select(*START, c("to.module").alias("module"), c("to.signal").alias("signal"), F.when(c("done"), c("seen")).otherwise(F.array_append("seen", c("to"))).alias("seen"), F.concat("ord", F.array("id", "k")).alias("ord"), "done")
        both = moved if chains is None else chains.unionByName(moved)
        kept = cut(both.withColumn("n", F.row_number().over(Window.partitionBy(*START).orderBy("ord"))).where(c("n") <= most).drop("n"))
        chains, ways = kept.where("done"), kept.where("not done").drop("done")
        if ways.isEmpty():
            break
    chain = F.row_number().over(Window.partitionBy(*START).orderBy("ord")) - 1
    # of a chain, ord holds the number of each state's hop and of what it led to
    linked = chains.withColumn("chain", chain).select(*START, "chain", "ord", F.posexplode("seen").alias("pos", "to"))
    linked = linked.select(*START, "chain", "pos", F.lit(None).cast("boolean").alias("truncated"), "to.module", "to.signal", F.get("ord", 2 * c("pos")).alias("id"))
    return _told(at.unionByName(linked), direct, modules)


def steps(traced: DataFrame) -> DataFrame:
    """(start_module, start_signal, step, direction, module, signal, label, detail, role, kind, variants, ops, path, line) through the chains of ``trace``.

    Each hop counts where it comes first; neighbours alike in signal, role, block and where they lead are one step with
    several variants and their expressions' classes. Steps go from the furthest of the fan-in to the origin and on.
    """
    linked = traced.where("chain IS NOT NULL").withColumn("at", F.struct("chain", "pos"))
    once = first_seen(linked, [*START, "module", "signal", "kind", "detail", "next_module", "next_signal"], ["at"])
    group = F.struct("module", "signal", "role", "block_name", "next_module", "next_signal")
    runs = islands(once.withColumn("like", group), "like", ["at"], START)
    op = F.when(c("op_category") != "wire", F.struct("at", "op_category"))
    items = ["module", "signal", "kind", "role", "expression", "label", "detail", "crosses", "next_module", "next_signal", "path", "line"]
    ops = F.array_distinct(F.transform(F.array_sort(F.collect_list(op)), lambda x: x["op_category"]))
    groups = runs.groupBy(*START, "island").agg(F.min_by(F.struct(*items), "at").alias("first"), F.count("*").alias("variants"), ops.alias("ops")).select(*START, "island", "variants", "ops", "first.*")
    plain = F.coalesce(F.nullif("label", F.lit("")), "signal")
    place = _text(c("next_module"), ".", c("next_signal"))
    headline = (
        F.when(c("role") == "pipeline", _text(c("signal"), F.when(F.coalesce("expression", F.lit("")) != "", _text(" ← ", c("expression"))).otherwise("")))
        .when(c("role") == "compute", F.coalesce(F.nullif("detail", F.lit("")), plain)).when(c("crosses") == "down", _text("↓ ", place)).when(c("crosses") == "up", _text("↑ ", place)).otherwise(plain)
    )
    order = ["direction", F.when(c("direction") == "fanin", -c("island")).otherwise(c("island"))]
    step = F.row_number().over(Window.partitionBy(*START[:2]).orderBy(*order)) - 1
    return groups.select(*START[:2], step.alias("step"), "direction", F.coalesce("next_module", "module").alias("module"), F.coalesce("next_signal", "signal").alias("signal"), headline.alias("label"), "detail", "role", "kind", "variants", "ops", "path", "line")


def warnings(traced: DataFrame, modules: DataFrame) -> DataFrame:
    """(start_module, start_signal, severity, kind, module, message): modules that a trace comes to and the catalog doesn't have, each once."""
    to = traced.select(*START[:2], F.coalesce("next_module", "module").alias("module")).distinct()
    gone = to.join(apart(modules.select("module")), "module", "left_anti")
    return gone.select(*START[:2], F.lit("warning").alias("severity"), F.lit("unresolved_module").alias("kind"), "module", _text("Module '", c("module"), "' is not in the loaded project; the trace stops at its border.").alias("message"))
