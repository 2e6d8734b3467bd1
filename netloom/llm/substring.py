"""Exact substring deduplication behind a count-min prefilter.

Every run of ``window`` words is a window. Words covered by a window whose word sequence also starts in a document
with a smaller id are removed; windows are judged on the input.

1. Each chunk makes a count-min sketch of its windows: ``ROWS`` rows of counters that stop at 2, each row as wide as
   four to eight cells a window of the whole corpus, addressed by independent hashes. A partition fills few of these
   cells, so it writes the counters that aren't zero. Sketches are merged by ranges of cells, and each chunk learns
   which of its cells count 2 or more. A merged counter is never less than the true count, so every repeated window
   counts 2 or more in all rows.
2. Only windows that do are sent on, once a chunk, as 128 bits of two independent hashes with the smallest id in the
   chunk. Shards group them by all these bits and answer whether a smaller id exists elsewhere. (Grouping the words
   themselves would take some eighty bytes a window; of 10^13 different windows, two share 128 bits with a probability
   of 10^-13.)
3. Each chunk marks the covered words of its documents.

Messages grow with the chunks' distinct windows and never with the square of a repeated one; no step holds more than
a chunk, or one shard of about 4 million keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_shard, ids_of, make_chunks, pack, pack_bits, pack_sorted, replies_of, shard_bits, texts_of, unpack, unpack_bits, unpack_sorted, with_replies
from .ids import whole
from .store import drop, materialize
from .words import hashes, tokenized, window_hashes

#: Rows of the sketch, and cells of a row for each window, at least.
ROWS, CELLS = 2, 4
#: Words of a chunk: the more, the fewer times a repeated window is sent.
WORDS_PER_CHUNK = 600_000
#: Multipliers of the windows' two hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MESSAGE = "shard long, chunk long, body binary, more binary, ids binary, missing binary"
NAMES = [x.split()[0] for x in MESSAGE.split(", ")]
REPLY = "shard long, chunk long, body binary"
#: Stands for a missing id beside the flag that says so.
LARGEST = np.iinfo(np.int64).max


class _Windows:
    """The windows of a chunk: two 64-bit hashes, document, first word; and the order in which messages name them."""

    def __init__(self, row, size: int):
        ids, self.missing, _ = ids_of(row)
        self.ids, self.texts = np.where(self.missing, LARGEST, ids), texts_of(row)
        vocabulary, codes, counts = tokenized(self.texts)
        self.counts, self.ends, self.n = counts, np.cumsum(counts), len(codes)
        doc = np.repeat(np.arange(len(counts)), counts)
        ok = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :]) if len(doc) >= size else np.array([], np.int64)
        self.hash, self.second = (window_hashes(hashes(vocabulary, seed)[codes], size, factor)[ok] for seed, factor in zip((42, 1234567), FACTORS))
        self.start, self.doc = ok, doc[ok]

    def cells(self, bits: int):
        """For each row of the sketch: (sorted cells with 64 bits, the lower ones 0; windows in each, 2 at most; the cell of each window)."""
        drop = np.uint64(64 - bits)
        for h in (self.hash, self.second)[:ROWS]:
            cells, at, n = np.unique(h >> drop, return_inverse=True, return_counts=True)
            yield cells << drop, np.minimum(n, 2), at

    def runs(self, keep: np.ndarray):
        """Of the windows kept: (their places sorted by both hashes, run of each, and of each run of equal ones both hashes, the smallest id and whether it's missing)."""
        places = np.flatnonzero(keep)
        order = np.lexsort((self.ids[self.doc[places]], self.missing[self.doc[places]], self.second[places], self.hash[places]))
        places = places[order]
        h, second = self.hash[places], self.second[places]
        new = np.r_[True, (h[1:] != h[:-1]) | (second[1:] != second[:-1])] if len(h) else np.array([], bool)
        first = np.flatnonzero(new)
        of = self.doc[places[first]]
        return places, np.cumsum(new) - 1, h[first], second[first], self.ids[of], self.missing[of]


def _flagged(row, w: _Windows, cell_bits: int, bits: int) -> np.ndarray:
    """The windows whose cells count 2 or more in every row of the sketch."""
    got, out = replies_of(row.sketch), np.ones(len(w.hash), bool)
    for k, (cells, n, at) in enumerate(w.cells(cell_bits)):
        seen = n > 1
        for shard, a, b in by_shard(cells, bits):
            if (k << bits) + shard in got:
                seen[a:b] |= unpack_bits(got[(k << bits) + shard], b - a)
        out &= seen[at]
    return out


def _merge_sketches(rows: pd.DataFrame) -> pd.DataFrame:
    parts = [unpack_sorted(x) for x in rows["body"]]
    cells, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    many = (n > 1)[at]
    out, k = [], 0
    for shard, chunk, p in zip(rows["shard"], rows["chunk"], parts):
        found = many[k : k + len(p)]
        k += len(p)
        if found.any():
            out.append((shard, chunk, pack_bits(found)))
    return pd.DataFrame(out, columns=["shard", "chunk", "body"])


def _group_exactly(rows: pd.DataFrame) -> pd.DataFrame:
    keys = [unpack_sorted(x) for x in rows["body"]]
    h, second, ids = np.concatenate(keys), np.concatenate([unpack(x, np.uint64) for x in rows["more"]]), np.concatenate([unpack(x, np.int64) for x in rows["ids"]])
    missing = np.concatenate([unpack_bits(x, len(p)) for x, p in zip(rows["missing"], keys)])
    order = np.lexsort((second, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])]
    first = np.flatnonzero(new)
    least, none = np.minimum.reduceat(ids[order], first), np.logical_and.reduceat(missing[order], first)
    of = np.cumsum(new) - 1
    smaller = np.empty(len(h), bool)
    smaller[order] = (least[of] < ids[order]) | (missing[order] & ~none[of])
    out, k = [], 0
    for shard, chunk, p in zip(rows["shard"], rows["chunk"], keys):
        found = smaller[k : k + len(p)]
        k += len(p)
        if found.any():
            out.append((shard, chunk, pack_bits(found)))
    return pd.DataFrame(out, columns=["shard", "chunk", "body"])


def covered_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, emit=None, schema: str | None = None, words_per_chunk: int = WORDS_PER_CHUNK) -> tuple[DataFrame, list[DataFrame]]:
    """One row per document from its id and ``emit(text, covered)``, by default the digest columns of `dedup_digests`; and the stored tables that it reads."""
    emit, schema = (emit, schema) if emit else (_digest, DIGEST)
    chunks = make_chunks(docs, doc_id, text, words=words_per_chunk)
    words, bits = shard_bits(chunks)
    cell_bits = min(60, max(bits + 1, int(np.ceil(np.log2(CELLS * max(words, 1) + 1)))))

    def sketches(batches):
        for batch in batches:
            for row in batch.itertuples():
                out = [((k << bits) + s, row.chunk, pack_sorted(cells[a:b]), None, None, None) for k, (cells, _, _) in enumerate(_Windows(row, window).cells(cell_bits)) for s, a, b in by_shard(cells, bits)]
                yield pd.DataFrame(out, columns=NAMES)

    def suspects(batches):
        for batch in batches:
            for row in batch.itertuples():
                w = _Windows(row, window)
                _, _, h, second, ids, missing = w.runs(_flagged(row, w, cell_bits, bits))
                out = [(s, row.chunk, pack_sorted(h[a:b]), pack(second[a:b]), pack(ids[a:b]), pack_bits(missing[a:b])) for s, a, b in by_shard(h, bits)]
                yield pd.DataFrame(out, columns=NAMES)

    def cut(batches):
        for batch in batches:
            for row in batch.itertuples():
                w = _Windows(row, window)
                places, run, h, _, ids, missing = w.runs(_flagged(row, w, cell_bits, bits))
                elsewhere, got = np.zeros(len(h), bool), replies_of(row.exact)
                for s, a, b in by_shard(h, bits):
                    if s in got:
                        elsewhere[a:b] = unpack_bits(got[s], b - a)
                of = w.doc[places]
                gone = places[elsewhere[run] | (w.ids[of] > ids[run]) | (w.missing[of] & ~missing[run])] if len(places) else places
                edge = np.bincount(w.start[gone], minlength=w.n + 1) - np.bincount(w.start[gone] + window, minlength=w.n + 1)
                covered = np.cumsum(edge[:-1]) > 0
                name, *names = [x.split()[0] for x in schema.split(", ")]
                out = pd.DataFrame([emit(t, covered[e - n : e]) for t, e, n in zip(w.texts, w.ends.tolist(), w.counts.tolist())], columns=names)
                out.insert(0, name, whole(w.ids, w.missing))
                yield out

    sketch = chunks.mapInPandas(sketches, MESSAGE).groupBy("shard").applyInPandas(_merge_sketches, REPLY)
    sketch = materialize(sketch, "sketch")
    exact = with_replies(chunks, sketch=sketch).mapInPandas(suspects, MESSAGE).groupBy("shard").applyInPandas(_group_exactly, REPLY)
    exact = materialize(exact, "exact")
    return with_replies(chunks, sketch=sketch, exact=exact).mapInPandas(cut, schema), [chunks, sketch, exact]


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(text: bytes, covered: np.ndarray) -> list[bytes]:
    words = text.split()
    return [w for w, c in zip(words, covered.tolist()) if not c] if covered.any() else words


def _digest(text: bytes, covered: np.ndarray):
    return (len(covered), int(covered.sum()), hashlib.sha256(b" ".join(_kept(text, covered))).hexdigest())


def _text(text: bytes, covered: np.ndarray):
    """The text as it was where nothing goes; else the kept words, with the line breaks that stood between them."""
    if not covered.any():
        return (hashlib.md5(text).digest(), None)
    import regex

    kept, gap, at = [], b"", 0
    for m, c in zip(regex.finditer(rb"[^\x20\x09-\x0D]+", text), covered.tolist()):
        gap = b"\n" if b"\n" in text[at : m.start()] or gap == b"\n" else b" "
        at = m.end()
        if not c:
            kept += [gap, m[0]]
            gap = b""
    return (hashlib.md5(text).digest(), b"".join(kept[1:]))


def dedup_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for every document.

    Null text: no words. Null id: larger than every other id. Rows of equal id are documents of their own, none of
    which is smaller than the other; so repeated rows lose nothing to each other. Texts under ``window`` words lose
    nothing. An empty table gives an empty result. Other columns are ignored.
    """
    return covered_words(docs, **options)[0]


def dedup_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts; a document that loses all its words goes, one that had none stays.

    Null and short texts stay as they are. A missing id is larger than every other; rows of one id lose nothing to each
    other, so repeated rows stay alike. Only the texts that change are stored. An empty table gives an empty result;
    other columns are carried, whatever their names.
    """
    cut, stored = covered_words(docs, doc_id, text, emit=_text, schema="id long, digest binary, kept binary", **options)
    changed = materialize(cut.where("kept is not null").select("id", "digest", F.decode("kept", "UTF-8").alias("kept_text")).distinct(), "changed")
    drop(*stored)
    keyed = docs.withColumn("__digest", F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))))
    on = (keyed[doc_id].eqNullSafe(changed["id"])) & (keyed["__digest"] == changed["digest"])
    joined = keyed.join(changed, on, "left").where("kept_text is null or kept_text <> ''")
    return joined.select(*[F.coalesce(F.col("kept_text"), F.col(text)).alias(c) if c == text else keyed[c] for c in docs.columns])
