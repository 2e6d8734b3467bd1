"""Personal data: patterns, and a skip-chain conditional random field over the tokens of each document.

Patterns find e-mail addresses, IP addresses, card and telephone numbers in their plain forms. The field labels the
tokens that have a digit or an at sign, and those that are the name of an address in the same text; all other tokens
are outside by definition, so they need no variable. Tokens that follow each other are linked, and so are tokens far
apart that are equal or similar (the same digits, the same last seven digits, the name of an address). Linked tokens
share a potential on their two labels, so that a number which one place shows to be a telephone number is taken for one
at other places too. Labels of pattern matches are given; the others come from loopy message passing.

The field's weights are fitted to the labels that the patterns give, by pseudo-likelihood: each token's label given
those of its neighbours. Every token counts once with its own features and once, with less weight, with hidden ones, so
that neighbours are learned from too. What this needs of a document is how often each (features, labels of neighbours,
label) occurs in it, and Spark adds these counts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import carried, whole

KINDS = ("email", "ip", "card", "phone")
#: Documents that the weights are fitted on, at most about.
SAMPLE = 20_000
#: Documents whose fields are solved together.
ROWS = 500
#: Weight of a token with hidden features.
HIDDEN_WEIGHT = 0.3
LABELS = 1 + len(KINDS)

# The patterns. Quantifiers that can't give back make long runs of digits linear, with the same matches.
NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SIGNS = re.compile(r"[0-9@]+")
TOKEN_CHARS = NAME + "@()"
TOKEN = re.compile(r"[A-Za-z0-9._%+@()-]++")
DIGITS = re.compile(r"[0-9]+")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: What a token looks like; the last ones stand for hidden features and for no neighbour.
SHAPES = "address at ip dotted plus area grouped luhn long d1 d3 d4 d5 d7 d9 d20 mixed name hidden none".split()
SHAPE = {s: i for i, s in enumerate(SHAPES)}
#: The labels that a token of each shape may get, beside outside.
MAY_BE = {"address": (1,), "name": (1,), "ip": (2,), "luhn": (3,), "d4": (3, 4), "d5": (3, 4), "plus": (4,), "area": (4,), "grouped": (4,), "d1": (4,), "d3": (4,), "d7": (4,), "d9": (4,)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        name = text[free:at]
        start = free + len(name.rstrip(NAME))
        free = at + 1
        if start < at and (host := HOST.match(text, at)):
            out.append((0, start, host.end()))
            free = host.end()
        at = text.find("@", free)
    if not SIGNS.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
    return out


def merged(text: str) -> list[tuple[int, int]]:
    """Matches with more digits than one number may have: what they run together may be entities, so it teaches nothing."""
    out = [m.span() for m in CARD.finditer(text) if m.end() - m.start() > 19 and sum(map(len, DIGITS.findall(m[0]))) > 19] if SIGNS.search(text) else []
    return sorted(out + ([m.span() for m in PHONE.finditer(text) if sum(map(len, DIGITS.findall(m[0]))) > 15] if "+" in text else []))


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the punctuation around it; brackets that don't pair go too."""
    word = text[start:end]
    start += len(word) - len(word.lstrip("._%-)@"))
    word = text[start:end].rstrip("._%-(+@")
    if word.count("(") != word.count(")"):
        start += len(word) - len(word.lstrip("("))
        word = word.lstrip("(").rstrip(")")
    return start, start + len(word)


def tokens(text: str, addresses: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the tokens that the field labels, in order: those with digits or at signs, and the names of addresses."""
    out, free = [], 0
    for m in SIGNS.finditer(text):
        if m.start() >= free:
            start = free + len(text[free : m.start()].rstrip(TOKEN_CHARS))
            free = TOKEN.match(text, m.start()).end()
            a, b = core(text, start, free)
            if a < b and SIGNS.search(text, a, b):
                out.append((a, b))
    names = {n for a, b in addresses if len(n := text[a : text.index("@", a, b)].lower()) >= 5 and not n.isalpha()}
    if names:
        more = (core(text, *m.span()) for m in TOKEN.finditer(text))
        out = sorted({*out, *[(a, b) for a, b in more if text[a:b].lower() in names]})
    return out


def shape(word: str) -> str:
    if word.isdigit():
        n = len(word)
        if 13 <= n <= 19:
            return "luhn" if luhn(word) else "long"
        return "d1" if n <= 2 else "d3" if n == 3 else "d4" if n == 4 else "d5" if n <= 6 else "d7" if n <= 8 else "d9" if n <= 12 else "d20"
    if "@" in word:
        return "address" if ADDRESS.fullmatch(word) else "at"
    found = DIGITS.findall(word)
    if not found:
        return "name"
    if any(c.isalpha() or c in "_%" for c in word):
        return "mixed"
    if word[0] == "+":
        return "plus"
    if word[0] == "(" and len(found) == 1:
        return "area"
    if set(word) <= set("0123456789."):
        if len(found) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in found):
            return "ip"
        return "dotted"
    if len("".join(found)) >= 13:
        return "luhn" if len("".join(found)) <= 19 and luhn("".join(found)) else "long"
    return "grouped"


def keys(word: str) -> list[str]:
    """What tokens must share to be linked from afar."""
    low = word.lower()
    digits = "".join(DIGITS.findall(word))
    out = ["w" + low] if len(low) >= 4 else []
    if "@" in low:
        out.append("w" + low[: low.index("@")])
    elif len(digits) >= 7:
        out.append("d" + digits)
        if len(digits) <= 12:
            out.append("t" + digits[-7:])
    return out


class Field:
    """The tokens of a text: places, shapes, given labels (-1: to be found), and links (from, to, whether from afar)."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.places = tokens(text, [(a, b) for k, a, b in base if k == 0])
        words = [text[a:b] for a, b in self.places]
        self.words, self.shapes = words, [SHAPE[shape(w)] for w in words]
        self.labels = self._given(base)
        self.text = text
        self.links = [(i, i + 1, 0) for i in range(len(words) - 1) if 1 <= self.places[i + 1][0] - self.places[i][1] <= 2 and text[self.places[i][1] : self.places[i + 1][0]].isspace()]
        last: dict = {}
        far = {}
        for i, w in enumerate(words):
            for k in keys(w):
                if k in last:
                    far[last[k], i] = None
                last[k] = i
        self.links += [(i, j, 1) for i, j in far if i != j]

    def _given(self, base) -> list[int]:
        """The label of the pattern match that a token lies in or meets, the first kind where there are more; else -1."""
        out = [-1] * len(self.places)
        for kind in range(len(KINDS)):
            spans, at = [(a, b) for k, a, b in base if k == kind], 0
            for i, (a, b) in enumerate(self.places):
                while at < len(spans) and spans[at][1] <= a:
                    at += 1
                if at < len(spans) and spans[at][0] < b and out[i] < 0:
                    out[i] = 1 + kind
        return out

    def sides(self) -> tuple[list[int], list[int]]:
        """Shapes of the tokens in front and behind, where they are next to each other."""
        before, after = [SHAPE["none"]] * len(self.words), [SHAPE["none"]] * len(self.words)
        for i, j, far in self.links:
            if not far:
                before[j], after[i] = self.shapes[i], self.shapes[j]
        return before, after

    def open(self) -> bool:
        return any(y < 0 and SHAPES[s] in MAY_BE for y, s in zip(self.labels, self.shapes))


def cases(field: Field) -> list[tuple]:
    """(shape, shape in front, shape behind, label in front, label behind, labels from afar, label) of every token outside merged numbers."""
    y = [max(k, 0) for k in field.labels]
    n = len(y)
    unsure, runs, at = set(), merged(field.text), 0
    for i, (a, b) in enumerate(field.places):
        while at < len(runs) and runs[at][1] <= a:
            at += 1
        if at < len(runs) and runs[at][0] < b and field.labels[i] < 0:
            unsure.add(i)
    left, right, far = [-1] * n, [-1] * n, [[0] * LABELS for _ in range(n)]
    for i, j, skip in field.links:
        if i in unsure or j in unsure:
            continue
        if skip:
            far[i][y[j]] = min(far[i][y[j]] + 1, 3)
            far[j][y[i]] = min(far[j][y[i]] + 1, 3)
        else:
            right[i], left[j] = y[j], y[i]
    before, after = field.sides()
    return [(*x, "".join(map(str, f)), k) for i, (*x, f, k) in enumerate(zip(field.shapes, before, after, left, right, far, y)) if i not in unsure]


def fit(counted: list[tuple], steps: int = 1_000, penalty: float = 1e-4) -> dict[str, np.ndarray]:
    """Weights from (*case, count). Without any case, every token is outside."""
    c = len(SHAPES)
    model = {"own": np.zeros((c, LABELS)), "before": np.zeros((c, LABELS)), "after": np.zeros((c, LABELS)), "next": np.zeros((LABELS, LABELS)), "far": np.zeros((LABELS, LABELS)), "bias": np.eye(LABELS)[0]}
    if not counted:
        return model
    rows = sorted(counted)
    own, before, after, left, right = (np.array([r[k] for r in rows]) for k in range(5))
    far = np.array([list(map(int, r[5])) for r in rows], float)
    y, weight = np.array([r[6] for r in rows]), np.array([r[7] for r in rows], float)
    hidden = np.full(len(rows), SHAPE["hidden"])
    own, before, after = np.r_[own, hidden], np.r_[before, hidden], np.r_[after, hidden]
    left, right, far, y = np.r_[left, left], np.r_[right, right], np.r_[far, far], np.r_[y, y]
    weight = np.r_[weight, HIDDEN_WEIGHT * weight]
    weight /= weight.sum()
    hot = lambda z, n: np.where(z[:, None] == np.arange(n), 1.0, 0.0)
    x = {"own": hot(own, c), "before": hot(before, c), "after": hot(after, c), "far": far}
    l, r, truth = hot(left, LABELS), hot(right, LABELS), hot(y, LABELS)
    grown = {k: np.full(v.shape, 1e-8) for k, v in model.items()}
    start = {k: v.copy() for k, v in model.items()}
    for _ in range(steps):
        s = model["bias"] + sum(f @ model[k] for k, f in x.items()) + l @ model["next"] + r @ model["next"].T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = weight[:, None] * (truth - p)
        g = {k: f.T @ off for k, f in x.items()} | {"next": l.T @ off + (r.T @ off).T, "bias": off.sum(axis=0)}
        g["far"] = np.eye(LABELS) * np.trace(g["far"])  # one weight for equal labels, whichever they are
        for k in model:
            d = g[k] - penalty * (model[k] - start[k])
            grown[k] += d * d
            model[k] += 0.2 * d / np.sqrt(grown[k])
    return model


def marginals(score: np.ndarray, links: np.ndarray, model: dict, rounds: int = 50, tolerance: float = 1e-4) -> np.ndarray:
    """Probabilities of the labels of all tokens, by message passing along ``links`` (from, to, far) until it settles."""
    if len(links):
        u, v = links[:, 0], links[:, 1]
        pair = np.stack([model["next"], model["far"]])[links[:, 2]]
        to_v, to_u = np.zeros((len(links), LABELS)), np.zeros((len(links), LABELS))
        ends = np.r_[v, u]
    belief = score
    for _ in range(rounds if len(links) else 0):
        spread = lambda m: m - np.log(np.exp(m - m.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - m.max(axis=1, keepdims=True)
        new_v = spread(np.logaddexp.reduce((belief[u] - to_u)[:, :, None] + pair, axis=1))
        new_u = spread(np.logaddexp.reduce((belief[v] - to_v)[:, None, :] + pair, axis=2))
        moved = max(np.abs(new_v - to_v).max(), np.abs(new_u - to_u).max())
        to_v, to_u = (to_v + new_v) / 2, (to_u + new_u) / 2
        messages = np.r_[to_v, to_u]
        belief = score + np.column_stack([np.bincount(ends, messages[:, k], len(score)) for k in range(LABELS)])
        if moved < tolerance:
            break
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def scores(field: Field, model: dict) -> np.ndarray:
    """Potentials of single tokens; a given label, and what a shape can't be, leave no choice."""
    before, after = field.sides()
    out = model["bias"] + model["own"][field.shapes] + model["before"][before] + model["after"][after]
    for i, (s, y) in enumerate(zip(field.shapes, field.labels)):
        for k in range(LABELS):
            if k != y if y >= 0 else k and k not in MAY_BE.get(SHAPES[s], ()):
                out[i, k] = -60.0
    return out


def fits(kind: int, word: str, echoed: bool) -> bool:
    """Whether a run of tokens of one label is an entity of that kind; ``echoed``: one far away has the label too."""
    digits = "".join(DIGITS.findall(word))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and (echoed or word[0] == "+") if kind == 3 else True


def added(text: str, field: Field, p: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, probability) of runs of tokens with one label that no pattern gave; where a run is no entity, of those of its tokens that are."""
    label = [y if y >= 0 else int(k) if q[k] > 0.5 else 0 for k, y, q in zip(p.argmax(axis=1), field.labels, p)]
    best = [k if y < 0 else 0 for k, y in zip(label, field.labels)]
    joined = {i for i, _, far in field.links if not far}
    echoed = {x for i, j, far in field.links if far and label[i] == label[j] for x in (i, j)}
    out, i = [], 0
    while i < len(best):
        j = i
        while best[i] and j in joined and best[j + 1] == best[i]:
            j += 1
        for parts in ([(i, j)], [(k, k) for k in range(i, j + 1)]) if best[i] else ():
            places = [(m, n, field.places[m][0], field.places[n][1]) for m, n in parts]
            whole_ones = [(best[i] - 1, a, b, float(p[m : n + 1, best[i]].min())) for m, n, a, b in places if fits(best[i] - 1, text[a:b], not echoed.isdisjoint(range(m, n + 1)))]
            out += whole_ones
            if whole_ones:
                break
        i = j + 1
    return out


def solve(texts: list[str], model: dict) -> list[tuple[list, list]]:
    """(pattern matches, added spans) of each text. The fields of all texts are solved at once."""
    base = [base_spans(t) for t in texts]
    fields = [(i, f) for i, t in enumerate(texts) if (f := Field(t, base[i])).open()]
    more: list[list] = [[] for _ in texts]
    if fields:
        first = np.cumsum([0, *[len(f.words) for _, f in fields]])
        links = [np.array(f.links, np.int64).reshape(-1, 3) + [k, k, 0] for (_, f), k in zip(fields, first)]
        p = marginals(np.concatenate([scores(f, model) for _, f in fields]), np.concatenate(links), model)
        for (i, f), a, b in zip(fields, first, first[1:]):
            more[i] = added(texts[i], f, p[a:b])
    return list(zip(base, more))


def train(docs: DataFrame, bound: int = SAMPLE, text: str = "text") -> dict[str, np.ndarray]:
    """The field's weights, from about ``bound`` documents drawn by a hash of their text, so repeated rows come together."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    share = min(1.0, bound / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    schema = "own int, before int, after int, l int, r int, far string, y int"

    def count(batches):
        for b in batches:
            out = [c for t in b["text"] if SIGNS.search(t) for c in cases(Field(t, base_spans(t)))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    names = [c.split()[0] for c in schema.split(", ")]
    counted = drawn.mapInPandas(count, schema).groupBy(*names).count().collect()  # kinds of cases, not tokens
    return fit([tuple(r) for r in counted])


def entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = SAMPLE) -> DataFrame:
    """(doc_id, kind, start, end, value, by_pattern, probability), a row for each span; end is exclusive.

    Null and empty texts have none; repeated rows and those of null ids are kept; other columns are ignored.
    """
    model = train(docs, bound, text)
    names = ["start", "end", "kind", "value", "by_pattern", "probability"]

    def run(batches):
        for b in batches:
            for i in range(0, len(b), ROWS):
                part = b.iloc[i : i + ROWS]
                out = []
                for k, m, t, (base, more) in zip(part["doc_id"], part["missing"], part["text"], solve(part["text"].tolist(), model)):
                    out += [(k, m, a, z, KINDS[kind], t[a:z], True, 1.0) for kind, a, z in base] + [(k, m, a, z, KINDS[kind], t[a:z], False, q) for kind, a, z, q in more]
                made = pd.DataFrame(out, columns=["doc_id", "missing", *names])
                yield made[names].assign(doc_id=whole(made["doc_id"], made["missing"]))

    rows = docs.select(*carried(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, kind string, start int, end int, value string, by_pattern boolean, probability double")


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = SAMPLE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Counts and digest are of the patterns' matches, spans of these and of what the field adds. A null text is an empty
    one. Repeated rows stay, and have equal results; so do rows of null ids. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    model = train(docs, bound, text)
    listed = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.iloc[i : i + ROWS]
                solved = solve(part["text"].tolist(), model)
                counts = {f"n_{kind}": [sum(s[0] == k for s in base) for base, _ in solved] for k, kind in enumerate(KINDS)}
                digests = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in solved]
                spans = [listed(sorted([*base, *[m[:3] for m in more]])) for base, more in solved]
                yield pd.DataFrame({"doc_id": whole(part["doc_id"], part["missing"]), **counts, "base_sha256": digests, "spans": spans})

    rows = docs.select(*carried(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
