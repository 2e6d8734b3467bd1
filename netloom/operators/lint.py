"""Brackets and blocks of design files that do not pair."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What opens and what may close it.
PAIRS = {
    "(": [")"], "[": ["]"], "{": ["}"], "begin": ["end"], "module": ["endmodule"], "case": ["endcase"], "casex": ["endcase"], "casez": ["endcase"],
    "function": ["endfunction"], "task": ["endtask"], "generate": ["endgenerate"], "specify": ["endspecify"], "fork": ["join", "join_any", "join_none"],
    "package": ["endpackage"], "interface": ["endinterface"], "class": ["endclass"], "config": ["endconfig"], "primitive": ["endprimitive"], "table": ["endtable"],
}
FOUND = "array<struct<line:int,column:int,message:string>>"
_CLOSERS = {c for closers in PAIRS.values() for c in closers}
_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|[A-Za-z_$][\w$]*|[()\[\]{}]', re.S)


def _unpaired(text: str) -> list[dict]:
    """An opener left of a closer that doesn't fit is reported if the closer fits one further out; else the closer is."""
    found, open_, before = [], [], ""
    for m in _TOKEN.finditer(text):
        word = m.group()
        if word in PAIRS and not (word == "fork" and before in ("disable", "wait")):
            open_.append((word, m.start()))
        elif word in _CLOSERS:
            fits = next((k for k in range(len(open_) - 1, -1, -1) if word in PAIRS[open_[k][0]]), None)
            if fits is None:
                found.append((m.start(), f"'{word}' closes nothing"))
            else:
                found += [(at, f"'{w}' is not closed") for w, at in open_[fits + 1 :]]
                del open_[fits:]
        before = word
    rows, line, start, seen = [], 1, 0, 0
    for at, message in sorted(found + [(at, f"'{w}' is not closed") for w, at in open_]):
        line, seen = line + text.count("\n", seen, at), at
        start = text.rfind("\n", 0, at) + 1
        rows.append({"line": line, "column": at - start + 1, "message": message})
    return rows


def lint(files: DataFrame) -> DataFrame:
    """(path, line, column, message) of brackets and block words without their partner in files (path, text).

    Comments and strings don't count. Null and empty texts have none; a file that pairs has no rows.
    """
    each = F.pandas_udf(lambda texts: pd.Series([_unpaired(t or "") for t in texts], index=texts.index, dtype=object), FOUND)
    return files.select("path", F.explode(each("text")).alias("f")).select("path", "f.line", "f.column", "f.message")
