"""Quality rules as weak supervision, with DataFrame operations only.

Every rule votes good or bad on a document, or abstains. Expectation-maximisation over the counts of vote patterns
estimates how often each rule votes what on good documents and on those of each defect; a document is kept by the
posterior probability of the good class, not by having passed every rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

WORD = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
WINDOW = 8
#: Rules: name, measure, votes good up to, votes bad from; it abstains between, and where the measure is null.
RULES = [
    ("symbols", "n_symbols / n_words", 0.02, 0.10),
    ("marks", "n_marks / n_words", 0.10, 0.30),
    ("capitals", "n_upper / word_chars", 0.20, 0.50),
    ("repeats", "n_repeat_words / n_words", 0.30, 0.50),
    ("lines", "n_dup_lines / n_lines", 0.40, 0.70),
    ("lengths", "abs(ln(word_chars / n_words / 5.5))", 0.50, 0.90),
]


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of 8 that come at least twice in the array of words."""
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
        return _let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(F.array_sort(pairs), repeated))

    return _let(hashes, count)


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts on which the rules vote, one row per document."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.length(F.array_join(w, "")).alias("word_chars")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), of_words.alias("w"), of_lines.alias("l"), F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit("[!?]")).alias("n_marks"), F.length(F.regexp_replace(body, r"\P{Lu}+", "")).alias("n_upper"),
    )
    long = lambda s, c: F.col(f"{s}.{c}").cast("long").alias(c)
    return rows.select("doc_id", long("w", "n_words"), long("w", "word_chars"), "n_symbols", long("l", "n_dup_lines"), long("w", "n_repeat_words"), long("l", "n_lines"), "n_marks", "n_upper")


def votes(rows: DataFrame, rules: list = RULES) -> DataFrame:
    """``rows`` with a column v_<rule> each: 1 good, 0 bad, 2 abstains."""
    for name, measure, good, bad in rules:
        m = F.expr(f"CASE WHEN n_words > 0 AND word_chars > 0 THEN {measure} END")
        rows = rows.withColumn(f"v_{name}", F.when(m <= good, 1).when(m >= bad, 0).otherwise(2))
    return rows


def learn(voted: DataFrame, rules: list = RULES, tolerance: float = 1e-4) -> list[dict]:
    """The classes found by expectation-maximisation: {"share": of the documents, (rule, vote): probability}.

    The first class is that of good documents; each rule adds a class of documents with the defect that it looks for,
    since a bad document mostly shows one defect and passes the other rules. All classes' vote probabilities for all
    rules are estimated, from a start in which rules are hardly ever wrong on good documents and mostly right on their
    own defect. Spark counts the vote patterns; the rounds work on these counts, of which there are at most 3 to the power
    of the rules (729), whatever the number of documents. One count is added
    to each probability's numerator, so none is 0. Rounds end when no share and no probability moves by more than
    ``tolerance``.
    """
    names = [f"v_{r[0]}" for r in rules]
    usual, own = {0: 0.002, 1: 0.958, 2: 0.04}, {0: 0.9, 1: 0.02, 2: 0.08}
    classes = [{"share": 0.8} | {(v, k): p for v in names for k, p in usual.items()}]
    for mine in names:
        rest = {0: 0.05, 1: 0.85, 2: 0.10}
        classes.append({"share": 0.2 / len(names)} | {(v, k): p for v in names for k, p in (own if v == mine else rest).items()})
    counts = [tuple(r) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    total, moved = sum(p[-1] for p in counts), 1.0
    while moved > tolerance:
        size = [0.0] * len(classes)
        cast = [[[0.0] * 3 for _ in names] for _ in classes]
        for *pattern, n in counts:
            likely = [c["share"] * math.prod(c[v, x] for v, x in zip(names, pattern)) for c in classes]
            scale = n / sum(likely)
            for k, p in enumerate(likely):
                size[k] += p * scale
                for j, x in enumerate(pattern):
                    cast[k][j][x] += p * scale
        new = [{"share": (size[k] + 1) / (total + len(classes))} | {(v, x): (cast[k][j][x] + 1) / (size[k] + 3) for j, v in enumerate(names) for x in range(3)} for k in range(len(classes))]
        moved = max(abs(x[p] - y[p]) for x, y in zip(classes, new) for p in x)
        classes = new
    return classes


def responsibilities(classes: list[dict], names: list[str]) -> Column:
    """The posterior probability of each class given the votes, as an array."""
    logs = []
    for c in classes:
        total = F.lit(math.log(c["share"]))
        for v in names:
            total = total + F.element_at(F.array(*[F.lit(math.log(c[v, k])) for k in range(3)]), F.col(v) + 1)
        logs.append(total)
    likely = lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    shares = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
    return _let(_let(F.array(*logs), likely), shares)


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list = RULES, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and posterior (of the good class).

    A null text has no words and fails the base; so does a text under 20 words, or one with over 30 % of its words in
    repeated windows. Ids play no part: null and repeated ones are rows like any other. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = materialize(votes(measures(docs, doc_id, text), rules), "votes")
    classes = learn(rows, rules)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quality = F.get(responsibilities(classes, [f"v_{r[0]}" for r in rules]), 0)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), quality.alias("posterior"))
