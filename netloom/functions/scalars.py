"""Scalar functions over design text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the expression classes, in the order in which they are tried; the first that matches names the class.
EXPRESSION_CLASSES = [
    ("mux", r"\?\s*[^:]+:|\bcase\b|\bcasez\b|\bcasex\b"),
    ("comparison", r"==|!=|<=(?!\s)|>=|(?<![<>=])<(?![<=])|(?<![<>=])>(?![>=])"),
    ("arithmetic", r"[+\-*/%]|<<|>>"),
    ("logic", r"[&|^~!]"),
]
# Words that name a port's rank (clock, reset, handshake); a bus ranks 3, everything else 4.
PORT_RANKS = [(0, ["clk", "clock"]), (1, ["rst", "reset", "clear"]), (2, ["en", "enable", "start", "valid", "ready", "busy"])]
# Words that name a block's region, in the order in which they are tried.
REGIONS = [
    ("decode_control", ["clk", "clock", "rst", "reset", "sched", "ctrl", "control", "decode", "router", "arb", "status"]),
    ("registers", ["reg", "state", "fifo", "buffer", "counter", "latch"]),
    ("memory_interface", ["ram", "rom", "mem", "spi", "uart", "i2c", "axi", "adc", "bridge", "iface", "interface", "bus"]),
    ("alu_datapath", ["alu", "data", "packet", "crc", "mux", "filter", "frontend", "sample", "frame", "sensor"]),
]
# Titles of regions; any other is titled Logic.
REGION_TITLES = {
    "input_interface": "Input Interface", "decode_control": "Decode / Control", "alu_datapath": "ALU / Datapath", "registers": "Registers / State",
    "memory_interface": "Memory / Interface", "output_interface": "Output Interface", "logic": "Logic",
}
# Words in the names of control signals.
CONTROL_WORDS = ["clk", "clock", "rst", "reset", "enable", "en", "start", "valid", "ready", "busy", "done"]
# Words in the names of control signals that a simplified schematic keeps.
SHOWN_CONTROLS = ["clk", "clock", "rst", "reset", "start", "busy", "valid", "ready"]
# The forms in which a log line states a simulation time.
TIME_FORMS = [
    r"\[\s*t\s*=\s*(\d+)\s*[a-zA-Z]*\s*\]",
    r"\(\s*t\s*=\s*(\d+)\s*[a-zA-Z]*\s*\)",
    r"@\s*(\d+)\s*[a-zA-Z]*",
    r"(?i)\bat\s+time\s*=?\s*(\d+)\s*[a-zA-Z]*",
    r"(?i)\bat\s+t\s*=\s*(\d+)\s*[a-zA-Z]*",
    r"(?i)\btime\s*=\s*(\d+)\s*[a-zA-Z]*",
]


def bus_width(width: Column) -> Column:
    """STRUCT(bit_width, is_bus) of a range such as [7:0]; bounds that aren't numbers give a bus of unknown width."""
    bound = lambda k: F.regexp_replace(F.trim(F.regexp_extract(width, r"\[\s*([^:\]]+)\s*:\s*([^\]]+)\s*\]", k)), "_", "").try_cast("int")
    n = F.abs(bound(1) - bound(2)) + 1
    return F.when(F.coalesce(width, F.lit("")) == "", F.struct(F.lit(1).alias("bit_width"), F.lit(False).alias("is_bus"))).otherwise(F.struct(n.alias("bit_width"), F.lit(True).alias("is_bus")))


def signal_reference(text: Column) -> Column:
    """STRUCT(base, slice, width, is_bus) of a name with at most one trailing selection; base is null for anything else."""
    pattern = r"^([A-Za-z_][A-Za-z0-9_$]*)\s*(\[(.+)\])?$"
    t = F.trim(text)
    base = F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    inner = F.regexp_extract(t, pattern, 3)
    part = F.regexp_extract(inner, r"[+-]:\s*(\d+)\s*$", 1).try_cast("int")
    high, low = (F.regexp_extract(inner, r"^\s*(\d+)\s*:\s*(\d+)\s*$", k).try_cast("int") for k in (1, 2))
    width = F.when(inner == "", F.lit(None)).when(inner.rlike(r"[+-]:"), part).when(inner.rlike(r"\]\["), F.lit(1)).when(inner.contains(":"), F.abs(high - low) + 1).otherwise(F.lit(1))
    return F.struct(base.alias("base"), F.when(base.isNotNull() & (inner != ""), F.concat(F.lit("["), inner, F.lit("]"))).alias("slice"), F.when(base.isNotNull(), width).cast("int").alias("width"), F.coalesce(base.isNotNull() & (width > 1), F.lit(False)).alias("is_bus"))


def expression_class(text: Column) -> Column:
    """mux, comparison, arithmetic, logic or wire; null for an empty text."""
    out = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(None).cast("string"))
    for name, pattern in EXPRESSION_CLASSES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("wire")


def by_words(name: Column, table: list, last):
    out = None
    for value, words in table:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(name), F.lit(w))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(last)


def port_rank(name: Column, is_bus: Column) -> Column:
    return by_words(name, PORT_RANKS, F.when(is_bus, 3).otherwise(4))


def region(kind: Column, direction: Column, *names: Column) -> Column:
    """The schematic region of a node: that of its direction for a module's own port, else by the words in its names (of instance, module, label and ports)."""
    plain = lambda x: F.translate(F.lower(F.trim(F.coalesce(x, F.lit("")))), "-", "_")
    io = F.when(plain(direction) == "input", "input_interface").otherwise("output_interface")
    return F.when(kind == "module_io", io).otherwise(by_words(F.concat_ws(" ", *map(plain, names)), REGIONS, "logic"))


def region_title(region: Column) -> Column:
    titles = F.create_map(*[F.lit(x) for pair in REGION_TITLES.items() for x in pair])
    return F.coalesce(titles[region], F.lit(REGION_TITLES["logic"]))


def hop_role(kind: Column, style: Column, blocking: Column) -> Column:
    """What a hop of a trace does to the signal: dead_end, transport, pipeline, compute or unknown."""
    clocked = F.coalesce(~blocking & (style == "seq"), F.lit(False))
    ports = ("instance_pin_in", "instance_pin_out", "module_port_in", "module_port_out")
    return F.when(kind == "dead_end", "dead_end").when(kind.isin(*ports), "transport").when((kind == "always") & clocked, "pipeline").when(kind.isin("always", "assign", "gate"), "compute").otherwise("unknown")


def is_noise(signal: Column) -> Column:
    """Whether a trace leaves a signal out: it has no name, or is the net of an open pin."""
    return (F.coalesce(signal, F.lit("")) == "") | F.startswith(signal, F.lit("__open__:"))


def snap(value: Column, grid: int = 20) -> Column:
    """The nearest grid line; ties go to the even one."""
    return (F.bround(value / grid) * grid).cast("bigint")


def event_time(line: Column) -> Column:
    """The first simulation time that a log line states, by the forms in their order."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")).try_cast("bigint") for p in TIME_FORMS])


def endpoint_role(direction: Column) -> Column:
    return F.when(direction == "output", "source").when(direction == "input", "sink").when(direction == "inout", "bidir").otherwise("unknown")


def hex_digits(bits: Column, width: Column) -> Column:
    """A binary text of any width as hexadecimal digits, aligned at the lowest bit; x or z anywhere gives x for every digit."""
    n = F.ceil(width / 4).cast("int")
    full = F.lpad(bits, F.greatest(n, F.ceil(F.length(bits) / 4).cast("int")) * 4, F.lit("0"))
    digits = F.transform(F.sequence(F.lit(1), F.length(full), F.lit(4)), lambda k: F.lower(F.conv(F.substr(full, k, F.lit(4)), 2, 16)))
    return F.when(bits.rlike("[xXzZ]"), F.repeat(F.lit("x"), n)).when(F.length(bits) == 0, F.repeat(F.lit("0"), n)).otherwise(F.array_join(digits, ""))


def bus_value(bits: Column, width: Column, radix: str) -> Column:
    """A dumped value as text in ``radix``: bin, hex, dec or sdec. An x anywhere gives only x, else a z only z; reals stay.

    Hexadecimal digits are aligned at the lowest bit. Decimals reach 126 bits and are null beyond. Empty values are null.
    """
    if radix not in ("bin", "hex", "dec", "sdec"):
        raise ValueError(f"no such radix: {radix}")
    n = F.ceil(width / (4 if radix == "hex" else 1)).cast("int")
    if radix == "bin":
        text = F.concat(F.lit("b"), F.lpad(bits, F.greatest(width, F.length(bits)), F.lit("0")))
    elif radix == "hex":
        text = F.concat(F.lit("h"), F.upper(hex_digits(bits, width)))
    else:
        whole, two = "decimal(38,0)", lambda x: F.lit(x).cast("decimal(1,0)")
        number = lambda b: F.aggregate(F.split(b, ""), F.lit(0).cast(whole), lambda acc, c: (acc + acc + F.when(c == "1", two(1)).otherwise(two(0))).cast(whole))
        negative = (F.length(bits) >= width) & (F.substr(bits, F.length(bits) - width + 1, F.lit(1)) == "1") & F.lit(radix == "sdec")
        # the complement plus one, so that no power of two is needed
        flipped = number(F.translate(F.right(bits, width), "01", "10")) + two(1)
        text = F.when(F.length(bits) > 126, F.lit(None)).when(negative, F.concat(F.lit("-"), flipped.cast("string"))).otherwise(number(bits).cast("string"))
    return F.when(F.length(bits) == 0, F.lit(None)).when(bits.rlike("[xX]"), F.repeat(F.lit("x"), n)).when(bits.rlike("[zZ]"), F.repeat(F.lit("z"), n)).when(bits.rlike(r"^-?\d+\.\d+"), bits).otherwise(text)


def time_text(time: Column) -> Column:
    """A time with two digits and the letter of its thousands (k, M, G); whole below a thousand."""
    short = lambda by, letter: F.format_string(f"%.2f{letter}", time.cast("double") / by)
    return F.when(time >= 1e9, short(1e9, "G")).when(time >= 1e6, short(1e6, "M")).when(time >= 1e3, short(1e3, "k")).otherwise(F.floor(time.cast("double") + 0.5).cast("string"))


def tick_step(span: Column, ticks: int = 8) -> Column:
    """The least of 1, 2 and 5 times a power of ten that cuts ``span`` into at most ``ticks`` steps; null unless positive."""
    raw = span.cast("double") / ticks
    ten = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(span > 0, ten * F.when(raw <= ten, 1).when(raw <= 2 * ten, 2).when(raw <= 5 * ten, 5).otherwise(10))


def natural_key(name: Column) -> Column:
    """What to sort names by so that a2 comes before a10: digits by number, letters without case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.ltrim(p, F.lit("0"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 5, "0"), digits(p))).otherwise(p)), "")


def is_control_name(name: Column) -> Column:
    """Whether a signal's name holds a word of clocks, resets and handshakes."""
    return F.lower(name).rlike("|".join(CONTROL_WORDS))


def shortened(text: Column, limit: int) -> Column:
    """A text over ``limit`` characters as its two ends with a note of what is left out between them."""
    half = limit // 2
    note = F.concat(F.lit("\n…["), (F.length(text) - limit).cast("string"), F.lit(" chars truncated]…\n"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(half)), note, F.right(text, F.lit(half))))
