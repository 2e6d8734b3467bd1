"""Toxicity classifier with counterfactual regularisation.

A logistic model over the densities of words and word beginnings. For each sentence of a labelled text that names a
group of people, the identity term is swapped for others of its kind, and the loss charges the squared change of the
sentence's margin: what the model thinks must not hang on which group is named. A mention alone then moves no score,
though such mentions be commoner in the toxic texts that the model learns from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import pack, pack_sorted, unpack, unpack_sorted
from .labelled import sample
from .nbsvm import apply
from .words import mix, window_hashes

BITS = 20
#: Bytes of a word's beginning that are features, beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 10)
#: Words of more bytes are long: they are hashed apart, and runs of WINDOWS bytes all along them are features too.
WORD_BYTES = 24
WINDOWS = (6, 9)
#: A feature's value is log(1 + DENSITY * share of the words).
DENSITY = 300.0
#: Texts that share what is found of their words.
PART = 1024
#: Labelled rows that the model is fitted on, at most about.
SAMPLE = 8_000
#: Features need this likelihood ratio (G squared) against independence of the label.
LEAST_G2 = 20.0

# Identity terms by kind, in the languages of the corpus.
IDENTITY_TERMS = {
    "religion": "christian muslim jewish hindu buddhist atheist catholic sikh".split(),
    "religions": "christians muslims jews hindus buddhists atheists catholics sikhs".split(),
    "gender": "women men girls boys".split(),
    "orientation": "gay straight lesbian bisexual heterosexual transgender".split(),
    "origin": "african american asian european mexican arab chinese indian".split(),
    "colour": "black white brown".split(),
    "age": "old young elderly teenage".split(),
    "ability": "disabled deaf blind autistic".split(),
    "deutsch": "frauen männer christen muslime juden ausländer".split(),
    "français": "femmes hommes chrétiens musulmans juifs étrangers".split(),
    "español": "mujeres hombres cristianos musulmanes judíos extranjeros".split(),
}
#: Other ASCII than letters and digits, and such characters beyond ASCII (bytes that are no UTF-8 stay).
ASCII_CUTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
OTHER_CUTS = regex.compile(r"[^\p{L}\p{M}\p{N}\p{Cs}\x00-\x7f]+")
SENTENCE = regex.compile(rb"[^.!?\n]+")


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, int]:
    """(feature of each word, beginning and window, repeats included; number of words); A-Z count as a-z.

    Words are runs of letters and digits. A run without white space that isn't such a word counts as a whole too. Every
    ``WINDOWS[0]`` bytes of a long word count as a word.
    """
    words, others, runs = _parts(text)
    if not runs:
        return np.array([], np.int64), 0
    return _hashed(words + others, len(words), bits)[0], max(len(words), runs) + sum(map(_more, words))


def _parts(text: bytes) -> tuple[list[bytes], list[bytes], int]:
    """The words of a text, its other runs without white space, and the number of all runs."""
    low = text.lower()
    runs = low.split()
    if runs and not low.isascii():
        low = OTHER_CUTS.sub(" ", low.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")
    words = low.translate(ASCII_CUTS).split()
    known = set(words)
    return words, [r for r in runs if r not in known], len(runs)


def _more(word: bytes) -> int:
    """As how many words more than one a word counts."""
    return len(word) // WINDOWS[0] - 1 if len(word) > WORD_BYTES else 0


def _hashed(parts: list[bytes], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, number of the part that has it) of parts, of which the first ``n`` are words and the others have one feature, their whole."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    raw = np.frombuffer(b" ".join(parts) + bytes(WORD_BYTES), np.uint8)
    h, out, of = np.zeros(len(parts), np.uint64), [], []
    for j in range(min(WORD_BYTES, int(size.max()))):
        on = j < size
        h = np.where(on, h * np.uint64(1099511628211) + raw[start + j] + np.uint64(1), h)
        if j + 1 in BEGINNINGS:
            of.append(np.flatnonzero(on[:n]))
            out.append(mix(h[of[-1]] + np.uint64((j + 1) << 40)))
    for i in np.flatnonzero(size > WORD_BYTES).tolist():
        h[i] = xxhash.xxh64_intdigest(parts[i], 42)
        if i < n:
            units = raw[start[i] : start[i] + size[i]].astype(np.uint64) + np.uint64(1)
            for k in WINDOWS:
                out.append(mix(window_hashes(units, k, 1099511628211) + np.uint64(k << 48)))
                of.append(np.full(len(out[-1]), i))
    out.append(mix(h + np.uint64(99 << 40)))
    of.append(np.arange(len(parts)))
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(of)


def kept_counts(texts: list[bytes], place: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each text (places, how often its features have them, number of words) as `features` counts them; ``place`` is -1 for a feature that isn't kept.

    What a word has is found once for ``PART`` texts, not wherever it stands.
    """
    for i in range(0, len(texts), PART):
        words, others, rows = {}, {}, []
        for t in texts[i : i + PART]:
            mine, rest, runs = _parts(t)
            codes = [words.setdefault(w, len(words)) for w in mine]
            rows.append((codes, [others.setdefault(r, len(others)) for r in rest], max(len(mine), runs)))
        if not words and not others:
            yield from ((place[:0], place[:0], 0) for _ in rows)
            continue
        f, of = _hashed([*words, *others], len(words), bits)
        at = place[f]
        of, at = of[at >= 0], at[at >= 0]
        at = at[np.argsort(of, kind="stable")]
        many = np.bincount(of, minlength=len(words) + len(others))
        first = np.cumsum(many) - many
        more = np.fromiter(map(_more, words), np.int64, len(words))
        for codes, rest, n in rows:
            mine = np.array(codes, np.int64)
            parts = np.r_[mine, np.array(rest, np.int64) + len(words)]
            size = many[parts]
            ends = np.cumsum(size)
            got = at[np.arange(int(size.sum())) + np.repeat(first[parts] - (ends - size), size)]
            yield *np.unique(got, return_counts=True), n + int(more[mine].sum())


def swaps(text: bytes, terms: dict = IDENTITY_TERMS, each: int = 2) -> list[tuple[bytes, bytes]]:
    """(sentence, sentence with one identity term swapped) for every sentence with such terms, ``each`` times a term."""
    kind = {t.encode(): [x.encode() for x in group] for group in terms.values() for t in group}
    out = []
    for s in SENTENCE.findall(text.lower()):
        words = s.split()
        for i, w in enumerate(words):
            bare = w.strip(b",;:'\"()")
            if group := kind.get(bare):
                at = group.index(bare)
                for k in range(1, min(each, len(group) - 1) + 1):
                    out.append((b" ".join(words), b" ".join([*words[:i], w.replace(bare, group[(at + k) % len(group)]), *words[i + 1 :]])))
    return out


def changes(text: bytes, terms: dict = IDENTITY_TERMS, each: int = 2, bits: int = BITS):
    """((features, values), (features, values)) before and after each swap of `swaps`, of the features that it changes.

    A run without white space has the same features wherever it stands, so only those of the swapped run are counted
    again, and a text costs a sentence once and each of its terms a few words, however long the sentence is.
    """
    kind = {t.encode(): [x.encode() for x in group] for group in terms.values() for t in group}
    for s in SENTENCE.findall(text.lower()):
        runs = s.split()
        found = [(w, bare) for w in runs if (bare := w.strip(b",;:'\"()")) in kind]
        if not found:
            continue
        f, n = features(s, bits)
        f, c = np.unique(f, return_counts=True)
        for w, bare in found:
            group = kind[bare]
            at, old = group.index(bare), features(w, bits)[0]
            for k in range(1, min(each, len(group) - 1) + 1):
                new = features(w.replace(bare, group[(at + k) % len(group)]), bits)[0]
                both, place = np.unique(np.r_[old, new], return_inverse=True)
                here = np.searchsorted(f, both)
                before = np.where(f[np.minimum(here, len(f) - 1)] == both, c[np.minimum(here, len(f) - 1)], 0)
                after = before + np.bincount(place, np.r_[-np.ones(len(old)), np.ones(len(new))], len(both)).astype(np.int64)
                yield (both, _value(before, n)), (both, _value(after, n))


def _value(counts: np.ndarray, words: int) -> np.ndarray:
    return np.log1p(DENSITY * counts / max(words, 1))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, pairs: list, bits: int = BITS, charge: float = 5.0, least_g2: float = LEAST_G2, epochs: int = 15) -> tuple[np.ndarray, np.ndarray, float]:
    """(features kept, their weights, bias) from (feature, value) rows, labels, and such rows for sentences and their swaps.

    Without both classes no feature is kept and the bias is that of the smoothed share of class 1.
    """
    n1, n = float(y.sum()), float(len(y))
    share = (n1 + 1) / (n + 2)
    b = float(np.log(share / (1 - share)))
    if n1 == 0 or n1 == n:
        return np.array([], np.int64), np.array([]), b
    counts = np.zeros((2, 1 << bits))
    for (f, _), k in zip(rows, y):
        counts[int(k)][f] += 1
    p, g2 = counts.sum(axis=0) / n, np.zeros(1 << bits)
    for seen, total in ((counts[1], n1), (counts[0], n - n1)):
        for got, want in ((seen, total * p), (total - seen, total * (1 - p))):
            ok = (got > 0) & (want > 0)
            g2[ok] += 2 * got[ok] * np.log(got[ok] / want[ok])
    kept = np.flatnonzero(g2 > least_g2)
    place = np.full(1 << bits, -1)
    place[kept] = np.arange(len(kept))

    def chosen(f, v):
        at = place[f]
        return at[at >= 0], v[at >= 0]

    a = [chosen(f, v) for f, v in rows]
    change = []
    for (f, v), (g, u) in pairs:
        (i, s), (j, t) = chosen(f, v), chosen(g, u)
        at, inv = np.unique(np.r_[i, j], return_inverse=True)
        d = np.bincount(inv, np.r_[s, -t], minlength=len(at))
        if np.abs(d).sum() > 1e-12:
            change.append((at, d))
    w, grown, draw = np.zeros(len(kept)), np.full(len(kept), 1e-6), np.random.default_rng(0)
    for _ in range(epochs):
        for i in draw.permutation(len(a) + len(change)):
            if i < len(a):
                f, v = a[i]
                off = 1 / (1 + np.exp(-np.clip(b + w[f] @ v, -500, 500))) - y[i]
                b -= 0.02 * off
                g = off * v + 1e-4 * w[f]
            else:
                f, d = change[i - len(a)]
                g = 2 * charge * (w[f] @ d) * d
            grown[f] += g * g
            w[f] -= 0.2 * g / np.sqrt(grown[f])
    return kept, w, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, terms: dict = IDENTITY_TERMS, charge: float = 5.0, least_g2: float = LEAST_G2, doc_id: str = "doc_id", text: str = "text", bits: int = BITS):
    """The model, as a function of a list of texts (bytes) to an array of scores."""

    def counted(t: bytes):
        f, n = features(t, bits)
        f, c = np.unique(f, return_counts=True)
        return f.astype(np.uint32), _value(c, n).astype(np.float32)

    def extract(batches):
        for batch in batches:
            out = []
            for y, t in zip(batch["y"], batch["text"]):
                t = bytes(t)
                made = [(y, counted(t)), *((k, x) for pair in changes(t, terms, bits=bits) for k, x in zip((2, 3), pair))]
                # what a swap changes, before it (2) and after (3), follow each other within one text's group of rows
                out += [(kind, pack_sorted(f.astype(np.uint32)), pack(v.astype(np.float32))) for kind, (f, v) in made]
            yield pd.DataFrame({"rows": [out_of(out)]})

    def out_of(rows):
        import pickle

        return pickle.dumps(rows)

    def fitted(batches):
        import pickle

        rows, ys, pairs, first = [], [], [], None
        groups = sorted(x for batch in batches for x in batch["rows"])  # whatever order they came in
        for group in groups:
            for kind, f, v in pickle.loads(group):
                r = unpack_sorted(f, np.uint32).astype(np.int64), unpack(v, np.float32).astype(np.float64)
                if kind < 2:
                    rows.append(r)
                    ys.append(kind)
                elif kind == 2:
                    first = r
                else:
                    pairs.append((first, r))
        kept, w, b = fit(rows, np.array(ys, float), pairs, bits, charge, least_g2)
        yield pd.DataFrame([(kept.astype(np.int64).tobytes(), w.astype(np.float64).tobytes(), b)], columns=["kept", "w", "b"])

    drawn = sample(docs, labels, label, bound, doc_id, text)
    model = drawn.mapInPandas(extract, "rows binary").repartition(1).mapInPandas(fitted, "kept binary, w binary, b double").first()
    kept, w, b = (np.frombuffer(model["kept"], np.int64), np.frombuffer(model["w"], np.float64), model["b"]) if model else (np.array([], np.int64), np.array([]), 0.0)

    def scores(texts: list[bytes]) -> np.ndarray:
        place = np.full(1 << bits, -1, np.int32)
        place[kept] = np.arange(len(kept))
        out = np.empty(len(texts))
        for i, (at, counts, n) in enumerate(kept_counts(texts, place, bits)):
            value = np.zeros(len(kept))
            value[at] = _value(counts, n)
            out[i] = 1 / (1 + np.exp(-np.clip(b + w @ value if len(kept) else b, -500, 500)))
        return out

    return scores


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A null text is an empty one: its score is that of no evidence. Rows of a null id aren't held out and never learned
    from. Without labels of both classes every score is the smoothed share of class 1. Repeated rows stay; other
    columns are ignored; an empty table gives an empty result.
    """
    return apply(docs, train(docs, labels, label, doc_id=doc_id, text=text, **options), threshold, doc_id, text)


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` less the rows whose score reaches the threshold.

    Null texts are scored as empty ones. Rows of equal texts go or stay together, whatever their ids, missing ones
    included. An empty table stays empty; other columns are carried, whatever their names.
    """
    scores = train(docs, labels, label, doc_id=doc_id, text=text, **options)

    @F.pandas_udf("double")
    def rated(texts: pd.Series) -> pd.Series:
        return pd.Series(scores([bytes(t) for t in texts]))

    return docs.where(rated(F.coalesce(F.col(text).cast("binary"), F.lit(b""))) < threshold)
