"""Design files and value change dumps as formats of Spark's reader: ``spark.read.format("rtl")`` and ``format("vcd")``.

    formats.register(spark)
    mods = spark.read.format("rtl").load("/designs")            # the rows of rtl.modules
    rtl.instances(mods.where("path LIKE '%/top.v'"))
    spark.read.format("vcd").load("/dumps").where("full_name = 'tb.clk'")

A partition is a group of files of about ``group_bytes``. Conditions on the path choose the files before any is opened,
and conditions on a dump's signal leave out other signals' changes while it is read. Options: ``endings`` (with commas),
``group_bytes``. Folders may be on any file system that pyarrow knows by its address.

A dump is read from its start to its end by one task. Where single dumps are large, ``vcd.lines`` reads them in blocks.
"""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from . import rtl, verilog

GROUP_BYTES = 64 << 20
_ADDRESS = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:/")
_PASSES = {
    EqualTo: lambda f: lambda x: x == f.value,
    In: lambda f: lambda x: x in f.value,
    StringStartsWith: lambda f: lambda x: x.startswith(f.value),
    StringEndsWith: lambda f: lambda x: x.endswith(f.value),
    StringContains: lambda f: lambda x: f.value in x,
}


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if _ADDRESS.match(path) else (fs.LocalFileSystem(), path)


class Files(DataSourceReader):
    """Groups of files; ``by`` names the columns whose conditions are met here."""

    by = ("path",)

    def __init__(self, options: dict, endings: str):
        self.root = options["path"]
        self.endings = tuple(e.lower() for e in options.get("endings", endings).split(","))
        self.group_bytes = int(options.get("group_bytes", GROUP_BYTES))
        self.tests: dict = {c: [] for c in self.by}

    def pushFilters(self, filters):
        for f in filters:
            made = _PASSES.get(type(f))
            if made and f.attribute[0] in self.by and len(f.attribute) == 1:
                self.tests[f.attribute[0]].append(made(f))
            else:
                yield f

    def passes(self, column: str, value: str) -> bool:
        return all(t(value) for t in self.tests[column])

    def partitions(self):
        from pyarrow import fs

        where, base = _opened(self.root)
        found = where.get_file_info(fs.FileSelector(base, recursive=True)) if where.get_file_info(base).type == fs.FileType.Directory else [where.get_file_info(base)]
        groups, held, n = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            parts = f.path[len(base) :].strip("/").split("/")
            hidden = any(p.lower() in rtl.SKIPPED_FOLDERS or p.startswith(".") for p in parts) or parts[-1].startswith("_")
            address = f"file:{quote(f.path)}" if where.type_name == "local" else self.root.split("://")[0] + f"://{f.path}"
            if f.type != fs.FileType.File or hidden or not f.path.lower().endswith(self.endings) or not self.passes(self.by[0], address):
                continue
            if held and n + f.size > self.group_bytes:
                groups.append(held)
                held, n = [], 0
            held, n = [*held, (address, f.path)], n + f.size
        return [InputPartition(g) for g in ([*groups, held] if held else groups)] or [InputPartition([])]

    def read(self, partition):
        where, _ = _opened(self.root)
        for address, path in partition.value:
            with where.open_input_stream(path) as f:
                yield from self.rows(address, f)


class Designs(Files):
    def rows(self, path, f):
        text = f.read().decode("utf-8", "replace")
        for n, m in enumerate(verilog.parse(verilog.blanked(text))["modules"]):
            yield path, n, m["module"], m["line"], m["ports"], m["items"]


class Dumps(Files):
    by = ("file", "full_name")

    def rows(self, path, f):
        import io

        stack, names, time, header = [], {}, 0, True
        for seq, line in enumerate(io.TextIOWrapper(f, "utf-8", "replace")):
            word = line.split()
            if not word:
                continue
            first = word[0]
            if header:
                if first == "$scope" and len(word) > 2:
                    stack.append(word[2])
                elif first == "$upscope":
                    del stack[-1:]
                elif first == "$var" and len(word) > 4:
                    name = " ".join(w for w in word[4:] if w != "$end")
                    names.setdefault(word[3], ".".join([*stack, name]))
                elif first.startswith("$enddefinitions"):
                    header = False
                    names = {i: n for i, n in names.items() if self.passes("full_name", n)}
            elif first[0] == "#":
                if (digits := re.match(r"#(\d+)", first)) and int(digits[1]) < 1 << 63:
                    time = int(digits[1])
            elif first[0] == "$":
                continue
            elif first[0] in "bBrR":
                if len(first) > 1 and len(word) > 1 and word[1] in names:
                    yield path, word[1], names[word[1]], time, seq, first[1:]
            elif (key := "".join(word)[1:]) in names and len(word) < 3:
                yield path, key, names[key], time, seq, first[0]


class RtlFormat(DataSource):
    @classmethod
    def name(cls):
        return "rtl"

    def schema(self):
        return f"path string, mod_ord int, module string, line int, ports {rtl.PORTS}, items {rtl.ITEMS}"

    def reader(self, schema):
        return Designs(self.options, ".v,.sv")


class VcdFormat(DataSource):
    @classmethod
    def name(cls):
        return "vcd"

    def schema(self):
        return "file string, id string, full_name string, time long, seq long, value string"

    def reader(self, schema):
        return Dumps(self.options, ".vcd")


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets Spark give them conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RtlFormat)
    spark.dataSource.register(VcdFormat)
