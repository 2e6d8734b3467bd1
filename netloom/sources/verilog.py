"""Statements of Verilog files: a recursive-descent parser over tokens that goes on after errors.

It gives modules with their ports and items, and a record of each stretch of text that is in none of them. After an
error it skips to a semicolon, an end word, or a line that starts with a word that only starts statements.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Collection
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

# Gate types, and words that cannot be names of signals or modules.
GATES = ["and", "or", "nand", "nor", "xor", "xnor", "not", "buf", "bufif0", "bufif1", "notif0", "notif1"]
RESERVED = [
    "module", "endmodule", "input", "output", "inout", "wire", "reg", "logic", "assign", "always", "always_comb", "always_ff", "always_latch",
    "initial", "begin", "end", "if", "else", "case", "casex", "casez", "endcase", "default", "for", "while", "repeat", "forever", "posedge",
    "negedge", "or", "parameter", "localparam", "integer", "real", "time", "genvar", "generate", "endgenerate", "function", "endfunction",
    "task", "endtask", "signed", "unsigned",
]
KEPT, GATE = frozenset(RESERVED), frozenset(GATES)
DECLARATIONS = {"wire", "reg", "logic"}
ALWAYS = {"always", "always_comb", "always_ff", "always_latch"}
#: Items that are passed over as a whole; what is inside them becomes no rows.
PASSED = set(
    "initial final generate function task specify begin if for case casex casez while repeat parameter localparam integer real realtime time genvar event input output inout defparam specparam "
    "tri tri0 tri1 triand trior trireg wand wor supply0 supply1 typedef import export bit byte int shortint longint string shortreal enum struct union assert assume cover property sequence "
    "covergroup clocking modport let alias timeunit timeprecision pullup pulldown nmos pmos cmos tran default const var chandle nettype bind".split()
)
#: Words that only start an item: after an error, reading goes on at a line that starts with one.
STARTS = {*DECLARATIONS, *ALWAYS, "assign", "initial", "generate", "function", "task", "specify", "parameter", "localparam", "input", "output", "inout"}
OPENS = {"begin", "case", "casex", "casez", "fork", "function", "task", "generate", "specify", "covergroup", "clocking", "property", "sequence"}
CLOSES = {"end", "endcase", "join", "join_any", "join_none", "endfunction", "endtask", "endgenerate", "endspecify", "endgroup", "endclocking", "endproperty", "endsequence"}
TYPE_WORDS = {"wire", "reg", "logic", "signed", "unsigned", "var", "tri", "bit", "integer"}
NET_WORDS = TYPE_WORDS | {"vectored", "scalared"}
STRENGTHS = {"supply0", "supply1", "strong0", "strong1", "pull0", "pull1", "weak0", "weak1", "highz0", "highz1", "small", "medium", "large"}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*", re.A)
TOKEN = re.compile(r'[A-Za-z_$][\w$]*|[()\[\]{},;.]|"(?:\\.|[^"\\])*"|\d*\'[sS]?[bodhBODH]\s*[\w?]+|\d[\w.]*|<<<|>>>|===|!==|<=|>=|==|!=|&&|\|\||<<|>>|\S', re.S)
#: A token with the space before it. Behind the last token there must be none: it would be tried from each of its places.
SPACED = re.compile(rf"\s*(?:{TOKEN.pattern})", TOKEN.flags)
#: What a file is divided by: words around modules, and brackets.
MODULE, OPEN, CLOSE = frozenset({"module", "macromodule", "endmodule"}), frozenset("([{"), frozenset(")]}")
MARKS = MODULE | OPEN | CLOSE
#: Read in place of an item that isn't wanted.
UNMADE: dict = {}
#: Statements of fewer tokens can't be nested too deeply for Python's stack.
SHALLOW = 500
COMMENT = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|//[^\n]*|/\*.*?\*/', re.S)


def blanked(text: str) -> str:
    """The text with comments blanked; strings and the number of lines stay."""
    return COMMENT.sub(lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0]), text)


def squeeze(text: str) -> str:
    return " ".join(text.split())


@lru_cache(1 << 14)
def _is_name(word: str) -> bool:
    return word not in KEPT and NAME.fullmatch(word) is not None


class Lost(Exception):
    """A token, by its number, that no rule allows."""

    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at = at


class Reader:
    """Tokens of a text from a position on, up to ``stop``. With ``kinds``, items of other kinds are read as far as errors need it, and None."""

    def __init__(self, text: str, kinds: Collection[str] | None = None):
        self.text, self.kinds = text, kinds
        spaced = SPACED.findall(text.rstrip())
        self.word = list(map(str.lstrip, spaced))
        self.ends = list(accumulate(map(len, spaced)))
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.stop = len(self.word)
        self.lost: list[dict] = []
        self.marks, self.closed, opened = [], {}, []
        for i, w in [x for x in enumerate(self.word) if x[1] in MARKS]:
            if w in OPEN:
                opened.append(i)
            elif w in MODULE:
                self.marks.append(i)
            elif opened:
                self.closed[opened.pop()] = i

    def start(self, i: int) -> int:
        return self.ends[i] - len(self.word[i])

    def line(self, i: int) -> int:
        at = self.start(i) if i < len(self.word) else len(self.text)
        return bisect_left(self.breaks, at) + 1

    def at(self, i: int) -> str:
        return self.word[i] if i < self.stop else ""

    def span(self, i: int, j: int) -> str:
        return squeeze(self.text[self.start(i) : self.ends[j - 1]]) if j > i else ""

    def wants(self, kind: str) -> bool:
        return self.kinds is None or kind in self.kinds

    def is_name(self, i: int) -> bool:
        return i < self.stop and _is_name(self.word[i])

    def report(self, kind: str, i: int, j: int, message: str, at: int | None = None) -> None:
        """Tokens i to j are in no row; ``at`` is the one where reading failed."""
        at = i if at is None else at
        token = self.word[at] if at < len(self.word) else ""
        self.lost.append({"kind": kind, "line": self.line(at), "token": token, "message": message, "text": self.span(i, j)})

    def past(self, i: int) -> int:
        """Behind the bracket that closes the one at i."""
        if self.closed.get(i, self.stop) < self.stop:
            return self.closed[i] + 1
        depth, start, word = 0, i, self.word
        while i < self.stop:
            depth += (word[i] in OPEN) - (word[i] in CLOSE)
            i += 1
            if depth == 0:
                return i
        raise Lost(start, f"'{self.word[start]}' is never closed")

    def until(self, i: int, stops: str) -> int:
        """The next of ``stops`` outside of brackets."""
        word, stop = self.word, self.stop
        while i < stop and (w := word[i]) not in stops:
            if w in CLOSE:
                raise Lost(i, f"'{w}' closes nothing")
            i = self.past(i) if w in OPEN else i + 1
        if i >= stop:
            raise Lost(i, f"one of {' '.join(stops)} is missing")
        return i

    def end_of_line(self, i: int) -> int:
        here = self.line(i)
        while i < self.stop and self.line(i) == here:
            i += 1
        return i

    def pieces(self, i: int, j: int) -> list[tuple[int, int]]:
        """Stretches of tokens i to j between commas outside of brackets."""
        out, start, word = [], i, self.word
        while i < j:
            if (w := word[i]) == ",":
                out.append((start, i))
                start = i + 1
            i = self.past(i) if w in OPEN else i + 1
        return [*out, (start, j)] if out or j > start else []

    # --- files

    def file(self) -> list[dict]:
        made, i, n = [], 0, len(self.word)
        marks = self.marks
        for k in (*marks, n):
            if k < i:
                continue
            self._outside(i, k)
            if k == n:
                break
            if self.word[k] == "endmodule":
                self.report("parse_failure", k, k + 1, "endmodule closes nothing")
                i = k + 1
                continue
            at = bisect_left(marks, k) + 1
            end = marks[at] if at < len(marks) else n
            if end == n or self.word[end] != "endmodule":
                self.report("parse_failure", k, end, "the module never ends")
                i = end
                continue
            self.stop = end
            if (found := self.module(k)) is not None:
                made.append(found)
            self.stop = n
            i = end + 3 if self.word[end + 1 : end + 2] == [":"] else end + 1
        return made

    def _outside(self, i: int, j: int) -> None:
        """Directives may stand between modules; anything else is reported, a row a stretch."""
        start = None
        while i < j:
            if self.word[i] == "`":
                if start is not None:
                    self.report("outside_module", start, i, "the text is in no module")
                    start = None
                i = min(self.end_of_line(i), j)
            else:
                start = i if start is None else start
                i += 1
        if start is not None:
            self.report("outside_module", start, j, "the text is in no module")

    # --- modules

    def module(self, i: int) -> dict | None:
        k = i + 1 + (self.at(i + 1) in ("automatic", "static"))
        if not self.is_name(k):
            self.report("parse_failure", i, self.stop, "the module has no name", k)
            return None
        out = {"module": self.word[k], "line": self.line(i), "ports": [], "items": []}
        self.unnamed = 0
        k += 1
        try:
            while self.at(k) == "import":
                k = self.until(k, ";") + 1
            if self.at(k) == "#":
                k = self.past(k + 1)
            if self.at(k) == "(":
                end = self.past(k)
                out["ports"] = self.ports(k + 1, end - 1)
                k = end
            if self.at(k) != ";":
                raise Lost(k, "';' is expected after the module's head")
            k += 1
        except Lost as error:
            k = self.recover(k, error)
        while k < self.stop:
            try:
                k, item = self.item(k)
                if item is not None:
                    out["items"].append(item or None)
            except Lost as error:
                k = self.recover(k, error)
            except RecursionError:
                k = self.recover(k, Lost(k, "nested too deeply"))
        return out

    def recover(self, start: int, error: Lost) -> int:
        """Where reading goes on after an error in the item at ``start``; what is skipped is reported."""
        i = max(min(error.at, self.stop), start)
        while i < self.stop:
            if self.word[i] == ";" or self.word[i] in CLOSES:
                i += 1
                break
            if i > start and self.word[i] in STARTS and self.line(i) > self.line(i - 1):
                break
            i += 1
        self.report("parse_failure", start, i, str(error), error.at)
        return i

    def ports(self, i: int, j: int) -> list[dict]:
        out, direction, width = [], None, None
        pieces = self.pieces(i, j)
        for n, (a, b) in enumerate(pieces):
            k, given = a, None
            if self.word[k : k + 1] == ["("] and self.word[k + 1] == "*":
                k = self.past(k)
            if k < b and self.word[k] in ("input", "output", "inout"):
                given, k = self.word[k], k + 1
            while k < b and self.word[k] in TYPE_WORDS:
                k += 1
            r = k
            while k < b and self.word[k] == "[":
                k = self.past(k)
            range_ = "".join(self.word[r:k]) or None
            k += k < b and self.word[k] == "."
            while k + 1 < b and self.is_name(k) and (self.is_name(k + 1) or self.word[k + 1] == "."):  # a named type, or an interface's part
                k += 1 if self.is_name(k + 1) else 2
            if k >= b or not self.is_name(k):
                self.report("parse_failure", a, b, "a port has no name", min(k, b - 1) if b > a else a)
                continue
            if given:
                direction, width = given, range_
            out.append({"ord": n, "name": self.word[k], "direction": direction or "unknown", "width": range_ or (None if given else width)})
        return out

    # --- items

    def item(self, i: int) -> tuple[int, dict | None]:
        """(behind the item at i, the item); None for what is no item, ``UNMADE`` for one that isn't wanted."""
        w = self.word[i]
        if w == ";":
            return i + 1, None
        if w == "`":
            return self.end_of_line(i), None
        if w == "(" and self.at(i + 1) == "*":
            return self.past(i), None
        if w in DECLARATIONS:
            return self.declaration(i)
        if w == "assign":
            return self.assignment(i)
        if w in ALWAYS:
            return self.always(i)
        if w in PASSED:
            return self.end_of(i), self.made(i, "other", w)
        if w in CLOSES or w in ")]}":
            raise Lost(i, f"'{w}' closes nothing")
        if w in GATE or self.is_name(i):
            return self.instances(i)
        raise Lost(i, "no statement starts like this")

    def made(self, i: int, kind: str, word: str, text: str | None = None, parts=(), steps=(), controls=()) -> dict:
        if not self.wants(kind):
            return UNMADE
        return {"line": self.line(i), "kind": kind, "type": word, "text": text, "parts": list(parts), "steps": list(steps), "controls": list(controls)}

    def part(self, i: int, name: str | None, value: str | None = None, args=()) -> dict:
        return {"name": name, "value": value, "line": self.line(i), "args": list(args)}

    def skip_strength(self, i: int) -> int:
        """Behind a drive strength and a delay."""
        if self.at(i) == "(" and self.at(i + 1) in STRENGTHS:
            i = self.past(i)
        if self.at(i) == "#":
            i = self.past(i + 1) if self.at(i + 1) == "(" else i + 2
        return i

    def after(self, i: int) -> tuple[int, bool]:
        """(behind the comma or semicolon at i, whether the list goes on)."""
        if self.at(i) not in (",", ";"):
            raise Lost(i, "',' or ';' is expected")
        return i + 1, self.word[i] == ","

    def declaration(self, i: int) -> tuple[int, dict]:
        k = self.skip_strength(i + 1)
        while self.at(k) in NET_WORDS:
            k += 1
        r = k
        while self.at(k) == "[":
            k = self.past(k)
        width = "".join(self.word[r:k]) or None
        k, parts, more, wanted = self.skip_strength(k), [], True, self.wants("declaration")
        while more:
            if not self.is_name(k):
                raise Lost(k, "a name is expected")
            at, value = k, None
            k += 1
            while self.at(k) == "[":
                k = self.past(k)
            if self.at(k) == "=":
                end = self.until(k + 1, ",;")
                value, k = self.span(k + 1, end) if wanted else None, end
            k, more = self.after(k)
            if wanted:
                parts.append(self.part(at, self.word[at], value))
        return k, self.made(i, "declaration", self.word[i], width, parts)

    def assignment(self, i: int) -> tuple[int, dict]:
        k, parts, more, wanted = self.skip_strength(i + 1), [], True, self.wants("assign")
        while more:
            mid = self.until(k, "=,;")
            if self.word[mid] != "=" or mid == k:
                raise Lost(mid, "a target and '=' are expected")
            end = self.until(mid + 1, ",;")
            if end == mid + 1:
                raise Lost(end, "an expression is expected")
            if wanted:
                parts.append(self.part(k, self.span(k, mid), self.span(mid + 1, end)))
            k, more = self.after(end)
        return k, self.made(i, "assign", "assign", None, parts)

    def instances(self, i: int) -> tuple[int, dict]:
        gate = self.word[i] in GATE
        kind = "gate" if gate else "instance"
        wanted = self.wants(kind)
        k, parts, more = self.skip_strength(i + 1) if gate else i + 1, [], True
        if not gate and self.at(k) == "#":
            k = self.past(k + 1) if self.at(k + 1) == "(" else k + 2
        while more:
            at, name = k, None
            if self.is_name(k):
                name, k = self.word[k], k + 1
            while self.at(k) == "[":
                k = self.past(k)
            if self.at(k) != "(":
                raise Lost(k, "'(' is expected")
            end = self.past(k)
            args = self.arguments(k + 1, end - 1, wanted)
            k, more = self.after(end)
            if not wanted:
                continue
            if name is None and gate:
                name, self.unnamed = f"{self.word[i]}_{self.unnamed}", self.unnamed + 1
            parts.append(self.part(at, name or f"inst_{len(parts)}", None, args))
        return k, self.made(i, kind, self.word[i], None, parts)

    def arguments(self, i: int, j: int, wanted: bool = True) -> list[dict]:
        out = []
        if not wanted and "." not in self.word[i:j]:
            return out
        for n, (a, b) in enumerate(self.pieces(i, j)):
            if self.word[a : a + 1] == ["."] and a < b:
                if not self.is_name(a + 1):
                    self.report("parse_failure", a, b, "a pin has no name of its own", min(a + 1, b - 1))
                elif a + 2 != b and (self.word[a + 2] != "(" or self.past(a + 2) != b):
                    raise Lost(a + 2, "'(' is expected")
                elif not wanted:
                    continue
                elif a + 2 == b:  # the signal of the same name
                    out.append({"port": self.word[a + 1], "value": self.word[a + 1]})
                else:
                    out.append({"port": self.word[a + 1], "value": self.span(a + 3, b - 1)})
            elif wanted:
                out.append({"port": f"arg{n}", "value": self.span(a, b)})
        return out

    def end_of(self, i: int) -> int:
        """Behind the item at i: its semicolon, or the end of its outermost block and what an else adds."""
        start, depth = i, 0
        while i < self.stop:
            w = self.word[i]
            if w in OPEN:
                i = self.past(i)
                continue
            if w in CLOSE:
                raise Lost(i, f"'{w}' closes nothing")
            depth += (w in OPENS) - (w in CLOSES)
            if depth < 0:
                raise Lost(i, f"'{w}' closes nothing")
            i += 1
            if depth == 0 and (w == ";" or w in CLOSES):
                if w in CLOSES and self.at(i) == ":":
                    i += 2
                if self.at(i) != "else":
                    return i
        raise Lost(start, "the statement never ends")

    def always(self, i: int) -> tuple[int, dict]:
        end, k, sensitivity = self.end_of(i), i + 1, ""
        if self.at(k) == "@":
            close = self.past(k + 1) if self.at(k + 1) == "(" else k + 2
            sensitivity = self.span(k + 2, close - 1) if close > k + 2 else self.at(k + 1)
        if end - i < SHALLOW and not self.wants("always"):
            return end, UNMADE
        steps, controls = procedure_of(self.text[self.start(i) : self.ends[end - 1]])
        names = ("target", "expression", "blocking", "condition", "condition_text")
        return end, self.made(i, "always", self.word[i], sensitivity, (), [dict(zip(names, s), line=self.line(i) + s[-1]) for s in steps], controls)


def procedure_of(text: str) -> tuple[list[tuple], list[str]]:
    """Assignments of a procedural item, (target, expression, blocking, innermost condition, all conditions' text, lines below the item's), and what its statements control.

    The latter are the ifs, cases and assignments of the item, or of its outer block, and the ifs and cases of blocks
    directly in that one.
    """
    toks, out, controls = list(TOKEN.finditer(text)), [], []
    word = list(map(itemgetter(0), toks))
    breaks = [m.start() for m in re.finditer("\n", text)]

    def span(i: int, j: int) -> str:
        return squeeze(text[toks[i].start() : toks[j - 1].end()]) if j > i else ""

    def past(i: int) -> int:
        """Behind the bracket that closes the one at i."""
        depth = 0
        while i < len(word):
            depth += (word[i] in "([{") - (word[i] in ")]}")
            i += 1
            if depth == 0:
                break
        return i

    def until(i: int, stops: set) -> int:
        while i < len(word) and word[i] not in stops:
            i = past(i) if word[i] in "([{" else i + 1
        return i

    def walk(i: int, cond: str, seen: str, rank: int = 3) -> int:
        """Behind the statement at i. Its rank is 0 for the item's own statement, 1 in its block, 2 in a block of that, 3 elsewhere."""
        while i < len(word) and word[i] in "@#":
            i = past(i + 1) if i + 1 < len(word) and word[i + 1] == "(" else i + 2
        if i >= len(word) or word[i] == ";":
            return i + 1
        if word[i] in ("begin", "fork"):
            i += 3 if word[i + 1 : i + 2] == [":"] else 1
            while i < len(word) and word[i] not in CLOSES:
                i = walk(i, cond, seen, min(rank + 1, 3))
            return i + (3 if word[i + 1 : i + 2] == [":"] else 1)
        if word[i] == "if":
            j = past(i + 1)
            c = span(i + 2, j - 1)
            i = walk(j, c, f"{seen} {c}")
            other = word[i : i + 1] == ["else"]
            if rank < 3:
                controls.append(f"if ({c})" + " / else" * other)
            return walk(i + 1, f"!({c})", f"{seen} {c}") if other else i
        if word[i] in ("case", "casex", "casez"):
            j = past(i + 1)
            c, plain, arms, i = span(i + 2, j - 1), word[i] == "case", 0, j
            while i < len(word) and word[i] != "endcase":
                arms += 1
                j = i + 1 if word[i] == "default" else until(i, {":"})
                guard = "" if word[i] == "default" else span(i, j)
                i = walk(j + 1 if word[j : j + 1] == [":"] else j, c, f"{seen} {c} {guard}")
            if plain and rank < 3:
                controls.append(f"case ({c}) [{arms} arms]")
            return i + 1
        if word[i] in ("for", "while", "repeat"):
            return walk(past(i + 1), cond, seen)
        if word[i] == "forever":
            return walk(i + 1, cond, seen)
        end, mid = until(i, {";"}), until(i, {"<=", "=", ";"})
        if mid < end:
            out.append((span(i, mid), span(mid + 1, end), word[mid] == "=", cond, seen.strip(), bisect_left(breaks, toks[i].start())))
            if rank < 2:
                controls.append(f"{span(i, mid)} {word[mid]} {span(mid + 1, end)}")
        return end + 1

    i = 1
    while i < len(word):
        i = walk(i, "", "", 0)
    return out, controls


def parse(text: str, kinds: Collection[str] | None = None) -> dict:
    """The modules of a text without comments, and what is in none of their rows. With ``kinds``, items of others are None."""
    reader = Reader(text, kinds)
    return {"modules": reader.file(), "lost": reader.lost}
