"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Indicators of a text's byte n-grams, and of its runs of one repeated word (an n-gram whose words are equal, whatever the
word), are scaled by class log-count ratios; a linear hinge-loss model is then fitted by dual coordinate descent. A
logistic curve fitted to the margins turns them into scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import pack_sorted, unpack_sorted
from .ids import carried, whole
from .labelled import held_out, sample
from .words import mix

BITS = 18
ORDERS = (1, 2, 3, 4)
#: Labelled rows that the model is fitted on, at most about.
SAMPLE = 6_000


class Grams:
    """Indicators of a text; one instance serves many texts, one after the other."""

    def __init__(self, bits: int = BITS, orders: tuple = ORDERS):
        self.bits, self.orders, self.seen = bits, orders, np.zeros(1 << bits, bool)

    def __call__(self, text: bytes) -> np.ndarray:
        """Sorted numbers of the indicators that are 1."""
        drop, seen = np.uint64(64 - self.bits), self.seen
        raw = np.frombuffer(b"\n" + text + b"\n", np.uint8).astype(np.uint64)
        h = np.zeros(len(raw), np.uint64)
        for n in range(1, max(self.orders) + 1):
            if n > len(raw):
                break
            h = h[: len(raw) - n + 1] * np.uint64(257) + raw[n - 1 :]
            if n in self.orders:
                seen[mix(h + np.uint64(n << 56)) >> drop] = True
        words = text.split()
        same = sum(map(bytes.__eq__, words[1:], words))
        shape = [same.bit_length() - (len(words) // 8).bit_length() if same else -64, 1000 + min(len(words), 16)]
        seen[mix(np.array(shape, np.int64).astype(np.uint64) + np.uint64(77 << 56)) >> drop] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found


def fit(features: list[np.ndarray], y: np.ndarray, dims: int, alpha: float = 1.0, cost: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float, float, float]:
    """(weights on the scaled indicators times their scale, bias, slope, offset of the logistic curve).

    Texts' scaled vectors have length 1; classes count alike. Without both classes, the margin is 0 everywhere and the
    score is the share of class 1 (1/2 without rows).
    """
    sign = np.where(y > 0, 1.0, -1.0)
    if not len(y) or (sign == sign[0]).all():
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(dims), 0.0, 1.0, float(np.log(share / (1 - share)))
    counts = np.full((2, dims), alpha)
    for f, k in zip(features, y):
        counts[int(k)][f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = []
    for f in features:
        v = ratio[f]
        rows.append(v / max(np.sqrt(v @ v), 1e-12))
    w, b, dual = np.zeros(dims), 0.0, np.zeros(len(y))
    most = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y <= 0).sum()))
    draw = np.random.default_rng(0)
    for _ in range(epochs):
        for i in draw.permutation(len(y)):
            f, v = features[i], rows[i]
            slack = sign[i] * (w[f] @ v + b) - 1
            new = min(max(dual[i] - slack / (v @ v + 1), 0.0), most[i])
            if new != dual[i]:
                w[f] += (new - dual[i]) * sign[i] * v
                b += (new - dual[i]) * sign[i]
                dual[i] = new
    margins = np.array([w[f] @ v + b for f, v in zip(features, rows)])
    slope, offset = 1.0, 0.0
    for _ in range(200):  # Newton's method, held back by a small penalty
        p = 1 / (1 + np.exp(-(slope * margins + offset)))
        g = np.array([((p - (y > 0)) * margins).mean() + 0.01 * slope, (p - (y > 0)).mean() + 0.01 * offset])
        k = p * (1 - p)
        h = np.array([[(k * margins * margins).mean() + 0.01, (k * margins).mean()], [(k * margins).mean(), k.mean() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return w, b, float(slope), float(offset), ratio


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, orders: tuple = ORDERS):
    """The model, as a function of a list of texts (bytes) to an array of scores."""

    def extract(batches):
        grams = Grams(bits, orders)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "f": [pack_sorted(grams(bytes(t)).astype(np.uint32)) for t in b["text"]]})

    def fitted(batches):
        ys, fs = [], []
        for b in batches:
            ys += b["y"].tolist()
            fs += [unpack_sorted(x, np.uint32).astype(np.int32) for x in b["f"]]
        order = sorted(range(len(ys)), key=lambda i: (ys[i], fs[i].tobytes()))  # whatever order the rows came in
        w, b, slope, offset, *ratio = fit([fs[i] for i in order], np.array([ys[i] for i in order]), 1 << bits)
        scale = ratio[0] if ratio else np.ones(1 << bits)
        yield pd.DataFrame([(w.astype(np.float32).tobytes(), scale.astype(np.float32).tobytes(), b, slope, offset)], columns=["w", "scale", "b", "slope", "offset"])

    model = sample(docs, labels, label, bound, doc_id, text).mapInPandas(extract, "y int, f binary").repartition(1).mapInPandas(fitted, "w binary, scale binary, b double, slope double, offset double").first()
    weights, scale = (np.frombuffer(model[k], np.float32).astype(np.float64) for k in ("w", "scale")) if model else (np.zeros(1 << bits), np.ones(1 << bits))
    b, slope, offset = (model["b"], model["slope"], model["offset"]) if model else (0.0, 1.0, 0.0)
    product = (weights * scale).astype(np.float32)
    square = (scale * scale).astype(np.float32)

    def scores(texts: list[bytes]) -> np.ndarray:
        grams, out = Grams(bits, orders), np.empty(len(texts))
        for i, t in enumerate(texts):
            f = grams(t)
            m = product[f].sum(dtype=np.float64) / max(np.sqrt(square[f].sum(dtype=np.float64)), 1e-12) + b
            out[i] = 1 / (1 + np.exp(-np.clip(slope * m + offset, -500, 500)))
        return out

    return scores


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A null text is an empty one and gets a score like any other. Rows of a null id aren't held out and never learned
    from. Without labels, or with those of one class only, every score is the smoothed share of class 1. Repeated rows
    stay; other columns are ignored; an empty table gives an empty result.
    """
    return apply(docs, train(docs, labels, label, doc_id=doc_id, text=text, **options), threshold, doc_id, text)


def apply(docs: DataFrame, scores, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(*carried(doc_id), held_out(doc_id).alias("held_out"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        for b in batches:
            s = scores([bytes(t) for t in b["text"]])
            yield pd.DataFrame({"doc_id": whole(b["doc_id"], b["missing"]), "held_out": b["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
