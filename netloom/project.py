"""A design project and a waveform under one name each, over the functions of sources and operators."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import design, graphs, lint, summaries, timeline, traces, views
from netloom.sources import files as project_files
from netloom.sources import rtl, vcd


def looks_like_bench(name, path):
    """Whether a module looks like a test bench by its name or its file's."""
    n, f = F.lower(name), F.lower(F.substring_index(path, "/", -1))
    return n.startswith("tb_") | n.endswith("_tb") | n.startswith("test_") | n.contains("testbench") | f.startswith("tb_") | f.contains("testbench")


class Design:
    """The catalog of a folder's design files. Tables are made at first use; ``refresh`` reads the folder again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Design:
        return cls(spark, root)

    def refresh(self) -> Design:
        return Design(self.spark, self.root)

    @cached_property
    def files(self) -> DataFrame:
        return rtl.scan(self.spark, self.root)

    @cached_property
    def _mods(self) -> DataFrame:
        return graphs.cut(rtl.modules(self.files))

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return design.catalog(self._mods)

    @cached_property
    def _hops(self) -> DataFrame:
        return graphs.cut(design.hops(self.tables))

    @cached_property
    def _names(self) -> DataFrame:
        return self.tables["modules"].select(F.col("module").alias("name"), looks_like_bench(F.col("module"), F.col("path")).alias("is_testbench"))

    def modules(self) -> DataFrame:
        return self.tables["modules"]

    def module(self, name: str) -> dict[str, DataFrame]:
        """Every table's rows of one module."""
        return {k: t.where(F.col("module") == name) for k, t in self.tables.items()}

    def tops(self) -> DataFrame:
        parents = self._names.select(F.col("name").alias("parent"), F.col("is_testbench").alias("parent_is_testbench"))
        return graphs.infer_tops(self._names, design.children(self.tables).join(parents, "parent"))

    def unused(self) -> DataFrame:
        """(name) of modules that nothing instantiates."""
        return graphs.unused(self._names, self.tables["instances"])

    def _tops(self, top: str | None) -> DataFrame:
        return self.tops().select(F.col("name").alias("node")) if top is None else self.spark.range(1).select(F.lit(top).alias("node"))

    def hierarchy(self, top: str | None = None) -> DataFrame:
        """``views.instance_tree`` under one module, or under all tops."""
        return views.instance_tree(self.tables, self._tops(top))

    def hierarchy_graph(self, top: str | None = None) -> tuple[DataFrame, DataFrame]:
        return views.hierarchy_graph(self.tables, self.hierarchy(top))

    def connectivity(self, module: str, mode: str = "compact", aggregate: bool = False, ports: bool = False, all_pairs: bool = False) -> DataFrame:
        """Edges within a module: ``compact`` from sources to sinks (``all_pairs`` as in ``design.connectivity``), ``detailed`` with nets as nodes; ValueError for another mode or an unknown module."""
        if mode not in ("compact", "detailed"):
            raise ValueError(f"no such mode: {mode}")
        if self.modules().where(F.col("module") == module).isEmpty():
            raise ValueError(f"no such module: {module}")
        ends = design.endpoints(self.tables).where(F.col("module") == module)
        ends = views.port_view(ends) if ports else ends
        if mode == "detailed":
            return views.net_graph(ends)
        edges = design.connectivity(ends, all_pairs)
        return views.aggregated(edges) if aggregate else edges

    def trace(self, module: str, signal: str, max_hops: int = 500) -> DataFrame:
        """Direct hops and chains, see ``traces.trace``."""
        if self.modules().where(F.col("module") == module).isEmpty():
            raise ValueError(f"no such module: {module}")
        return traces.trace(self.tables, self.spark.createDataFrame([(module, signal)], "module string, signal string"), max_hops)

    def trace_steps(self, module: str, signal: str, max_hops: int = 500) -> DataFrame:
        """What a reader steps through, from the furthest of the fan-in to the furthest of the fan-out."""
        return traces.steps(self.trace(module, signal, max_hops))

    def reach(self, module: str, signal: str, forward: bool = False) -> DataFrame:
        """(start, node, depth) of all that a signal depends on, or all that depends on it."""
        edges = design.hop_edges(self._hops)
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if forward else edges
        return graphs.reachable(edges, self.spark.range(1).select(F.lit(f"{module}.{signal}").alias("node")))

    def diagnostics(self) -> DataFrame:
        return rtl.diagnostics(self.files, self._mods)

    def lint(self) -> DataFrame:
        return lint.lint(self.files)

    def search(self, pattern: str, limit: int | None = 40) -> DataFrame:
        return project_files.search(self.files, pattern, limit=limit)

    def test_benches(self) -> DataFrame:
        return project_files.test_benches(self.files, project_files.below(self.spark, self.root, F.col("path")))


class Waveform:
    """The signals and changes of the dumps under a path."""

    def __init__(self, spark: SparkSession, path: str, max_signals: int | None = 4000):
        self.spark, self._lines = spark, vcd.lines(spark, path)
        self.signals = vcd.signals(self._lines, max_signals)
        self.changes = vcd.changes(self._lines, self.signals)
        self.end_times = vcd.end_times(self._lines)

    def _picked(self, terms: list[str] | None) -> DataFrame:
        return summaries.naming(self.changes, terms or [], "full_name")

    def snapshot(self, times: list[int], terms: list[str] | None = None) -> DataFrame:
        """(full_name, time, value): the value of each signal at each time, signals without one left out."""
        asked = self.spark.createDataFrame([(t,) for t in times], "time bigint")
        return timeline.as_of(self._picked(terms), asked, "full_name", "time", "seq", "value")

    def window(self, center: int, width: int = 20, terms: list[str] | None = None) -> DataFrame:
        """(time, full_name, value) of the changes at most ``width`` from a time, in order."""
        near = timeline.between(self._picked(terms), "time", max(0, center - width), center + width)
        return near.orderBy("time", "full_name", "seq").select("time", "full_name", "value")
