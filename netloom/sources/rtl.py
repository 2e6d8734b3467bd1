"""Design text as tables: modules, ports, signals, instances, pins, gates, assigns, always blocks, diagnostics.

Files are rows; a parser (`verilog`) makes them modules with ports and top-level items, since blocks nest, and says which text it could
not read; the tables are Column expressions over these items. Only what is not inside generate regions, functions and tasks becomes rows.
Spark's readers skip empty files and those whose names start with an underscore or a dot.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from netloom.functions.scalars import bus_width

from . import verilog
from .files import below
from .verilog import RESERVED

# Folders that scans leave out.
SKIPPED_FOLDERS = ["node_modules", "__pycache__", "venv", ".venv", "env"]
ID = r"[A-Za-z_][A-Za-z0-9_$]*"
PARTS = "array<struct<name:string,value:string,line:int,args:array<struct<port:string,value:string>>>>"
STEPS = "array<struct<target:string,expression:string,blocking:boolean,condition:string,condition_text:string,line:int>>"
PORTS = "array<struct<ord:int,name:string,direction:string,width:string>>"
ITEMS = f"array<struct<line:int,kind:string,type:string,text:string,parts:{PARTS},steps:{STEPS},controls:array<string>>>"
MODULES = f"path string, mod_ord int, module string, line int, ports {PORTS}, items {ITEMS}"
LOST = "path string, kind string, line int, token string, message string, text string"
#: Characters of text, parsed, that a task hands over at once; tasks a core, at least.
PIECE, WAVES, TASKS = 1 << 18, 4, 48


def tasks(spark: SparkSession) -> int:
    """How many tasks share rows that are few to read and many, or much work, behind that."""
    return max(WAVES * spark.sparkContext.defaultParallelism, TASKS)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified, text) of the design files under ``root``, folders of tools and hidden ones left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{v,V,sv,sV,Sv,SV}").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    files = raw.select(path.alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return files.where(~F.exists(F.split(below(spark, root, F.col("path")), "/"), lambda s: F.lower(s).isin(SKIPPED_FOLDERS) | s.startswith(".")))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """``values`` as Arrow, a field at a time: row by row, nested rows take as long to hand over as to parse. Lists aren't null; a struct may be."""
    if pa.types.is_list(kind):
        ends, flat = [0], []
        for v in values:
            flat += v
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _column(flat, kind.value_type), type=kind)
    if pa.types.is_struct(kind):
        there = [v for v in values if v is not None]
        made = pa.StructArray.from_arrays([_column([v[f.name] for v in there], f.type) for f in kind], fields=list(kind))
        if len(there) == len(values):
            return made
        place = count()
        return made.take(pa.array([None if v is None else next(place) for v in values], pa.int32()))
    return pa.array(values, kind)


def _batch(rows: list[dict], made: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column([r[f.name] for r in rows], f.type) for f in made], schema=made)


def _read(files: DataFrame, rows: Callable[[dict], list[dict]], schema: str, kinds: Collection[str] | None = None) -> DataFrame:
    """``rows`` of what the parser found in each of ``files``, in ``schema`` behind the path; with ``kinds``, items of others are None.

    Files are dealt anew, since a few large blocks of a table may hold very many small ones. Rows are handed over after each
    ``PIECE`` of text, so that a task's memory goes by its largest file and not by the number of files.
    """
    spark = files.sparkSession
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for path, text in zip(*batch.columns):
                path, text = path.as_py(), text.as_py()
                if text is None:  # not a filter: Spark would make each text for it, and again behind what deals files to tasks
                    continue
                found += [{"path": path, **row} for row in rows(verilog.parse(verilog.blanked(text), kinds))]
                size += len(text)
                if size >= PIECE and found:
                    yield _batch(found, made)
                    found, size = [], 0
        if found:
            yield _batch(found, made)

    texts = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return texts.repartition(tasks(spark), "path").mapInArrow(run, schema)


def modules(files: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """(path, mod_ord, module, line, ports, items) of each module of ``files`` (path, text) that has a name and an end.

    Null and empty texts have no modules. What of a module no rule reads is left out of its items, see `diagnostics`.
    With ``kinds``, items of other kinds are null, for tables that need few: they are read, since errors in them count, but not made.
    """
    return _read(files, lambda found: [{"mod_ord": n, **m} for n, m in enumerate(found["modules"])], MODULES, kinds)


def diagnostics(files: DataFrame, mods: DataFrame | None = None) -> DataFrame:
    """(path, severity, kind, line, token, message, text): all text that is in no row, a row for each stretch of it.

    Files without a text could not be read. In a broken statement, ``token`` and ``line`` are where reading failed, and
    text is what was skipped up to where it went on. The files are read again; ``mods`` isn't needed.
    """
    none = lambda kind: F.lit(None).cast(kind)
    unread = files.where("text IS NULL").select("path", F.lit("read_failure").alias("kind"), none("int").alias("line"), none("string").alias("token"), F.lit("the file could not be read").alias("message"), none("string").alias("text"))
    lost = _read(files, lambda found: found["lost"], LOST)
    out = unread.unionByName(lost)
    return out.select("path", F.when(F.col("kind") == "outside_module", "warning").otherwise("error").alias("severity"), "kind", "line", "token", "message", "text")


def ports(mods: DataFrame) -> DataFrame:
    """(path, module, ord, name, direction, width, bit_width, is_bus); a name after a comma has the direction and range before it.

    Names without any direction, as in lists whose declarations follow in the body, are ``unknown``.
    """
    rows = mods.select("path", "module", F.explode("ports").alias("p")).select("path", "module", "p.ord", "p.name", "p.direction", "p.width")
    b = bus_width(F.col("width"))
    return rows.select("*", b["bit_width"].alias("bit_width"), b["is_bus"].alias("is_bus"))


def _parts(mods: DataFrame, *kinds: str) -> DataFrame:
    """(path, module, ord, kind, type, text, pos, part, line), a row for each name that an item of the kinds declares."""
    rows = mods.select("path", "module", F.posexplode("items").alias("ord", "item")).where(F.col("item.kind").isin(*kinds))
    rows = rows.select("path", "module", "ord", "item.kind", "item.type", "item.text", F.posexplode("item.parts").alias("pos", "part"))
    return rows.withColumn("line", F.col("part.line"))


def signals(mods: DataFrame) -> DataFrame:
    """(path, module, ord, name, kind, width, bit_width, is_bus, line) of wire, reg and logic declarations, a row for each of their names."""
    b = bus_width(F.col("text"))
    return _parts(mods, "declaration").select("path", "module", (F.col("ord") * 1000 + F.col("pos")).alias("ord"), F.col("part.name").alias("name"), F.col("type").alias("kind"), F.col("text").alias("width"), b["bit_width"].alias("bit_width"), b["is_bus"].alias("is_bus"), "line")


def identifiers(text: Column) -> Column:
    """Distinct names of a text in order, without reserved words and the digits of sized numbers."""
    bare = F.regexp_replace(text, r"'[sS]?[bodhBODH]\s*[0-9a-zA-Z_?]+", "'")
    return F.array_except(F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"(?<![\w$])({ID})"), F.lit(1))), F.lit(RESERVED))


def assigns(mods: DataFrame, decl_assigns: bool = True) -> DataFrame:
    """(path, module, idx, target, expression, line, pos, sources) of continuous assigns; ``decl_assigns``: also of declared names with a value, other than regs.

    Targets of one statement share its idx and have their place in it as pos. Both are found in one pass: ``mods`` may be files that are parsed as they are read.
    """
    rows = _parts(mods, "assign", "declaration") if decl_assigns else _parts(mods, "assign")
    rows = rows.where("kind = 'assign' OR (type <> 'reg' AND part.value IS NOT NULL)")
    out = rows.select("path", "module", F.col("ord").alias("idx"), F.col("part.name").alias("target"), F.col("part.value").alias("expression"), "line", "pos")
    return out.withColumn("sources", identifiers(F.col("expression")))


def gates(mods: DataFrame) -> DataFrame:
    """(path, module, ord, name, gate_type, output, inputs, line); the first argument is the output, two at least are needed.

    Gates without a name have that of their type and their number among such gates of the module.
    """
    args = F.transform("part.args", lambda a: a["value"])
    rows = _parts(mods, "gate").select("path", "module", "ord", F.col("part.name").alias("name"), F.col("type").alias("gate_type"), args.alias("args"), "line").where("size(args) >= 2")
    return rows.select("path", "module", "ord", "name", "gate_type", F.get("args", F.lit(0)).alias("output"), F.expr("slice(args, 2, size(args) - 1)").alias("inputs"), "line")


def instances(mods: DataFrame) -> DataFrame:
    """(path, module, ord, name, child, connections, line) of each instance of another module; those without a name are inst_0, inst_1, … by their place in the statement."""
    return _parts(mods, "instance").select("path", "module", (F.col("ord") * 1000 + F.col("pos")).alias("ord"), F.col("part.name").alias("name"), F.col("type").alias("child"), F.col("part.args").alias("connections"), "line")


def pins(insts: DataFrame) -> DataFrame:
    """(path, module, instance, child, ord, child_port, parent_signal); unnamed pins are arg0, arg1, …; open ones have an empty signal."""
    rows = insts.select("path", "module", F.col("name").alias("instance"), "child", F.posexplode("connections").alias("ord", "p"))
    return rows.select("path", "module", "instance", "child", "ord", F.col("p.port").alias("child_port"), F.col("p.value").alias("parent_signal"))


def always_blocks(mods: DataFrame) -> DataFrame:
    """(path, module, ord, keyword, sensitivity, style, polarity, clock, title, label, steps, controls, line).

    Steps are the assignments inside, controls what its outer statements control. The title says what starts the block,
    the label its trigger in short.
    """
    rows = mods.select("path", "module", F.posexplode("items").alias("ord", "item")).where("item.kind = 'always'")
    kept = rows.select("path", "module", "ord", F.col("item.type").alias("keyword"), F.col("item.text").alias("sensitivity"), F.col("item.steps").alias("steps"), F.col("item.controls").alias("controls"), F.col("item.line").alias("line"))
    word, text = F.col("keyword"), F.col("sensitivity")
    edge, clock = (F.nullif(F.regexp_extract(text, rf"\b(posedge|negedge)\s+({ID})", k), F.lit("")) for k in (1, 2))
    pos, neg = text.rlike(rf"\bposedge\s+{ID}"), text.rlike(rf"\bnegedge\s+{ID}")
    style = F.when((word == "always_comb") | text.isin("*"), "comb").when((word == "always_ff") | pos | neg, "seq").when(word == "always_latch", "latch").otherwise("generic")
    polarity = F.when(pos & neg, "mixed").when(pos, "posedge").when(neg, "negedge").otherwise("level")
    at = F.when(text == "", "ALWAYS").otherwise(F.concat(F.lit("ALWAYS @("), text, F.lit(")")))
    title = F.when(style == "comb", "ALWAYS @(*)").otherwise(at)
    label = F.when(style == "comb", "COMB").when(style == "seq", F.concat_ws(" ", F.lit("SEQ"), edge, clock)).when(style == "latch", "LATCH").otherwise(title)
    return kept.select("path", "module", "ord", "keyword", "sensitivity", style.alias("style"), polarity.alias("polarity"), clock.alias("clock"), title.alias("title"), label.alias("label"), "steps", "controls", "line")


def always_assigns(blocks: DataFrame) -> DataFrame:
    """(path, module, block, ord, target, expression, blocking, condition, sources, condition_signals, style, line)."""
    rows = blocks.select("path", "module", F.col("ord").alias("block"), "style", F.posexplode("steps").alias("ord", "s"))
    return rows.select("path", "module", "block", "ord", "s.target", "s.expression", "s.blocking", F.nullif("s.condition", F.lit("")).alias("condition"), identifiers(F.col("s.expression")).alias("sources"), identifiers(F.col("s.condition_text")).alias("condition_signals"), "style", "s.line")
