"""Elias-Fano sequences, and an n-gram trie of two levels on memory-mapped files."""

from __future__ import annotations

import numpy as np


class EliasFano:
    """A sorted sequence of unsigned integers: low bits in an array, high bits in unary.

    ``successors(lo, hi, x)`` finds, in the stretch [lo, hi) of each query, the place of the first value not under x.
    """

    def __init__(self, values: np.ndarray, keep=lambda name, array: array, name: str = ""):
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        self.n, self.low_bits = n, max(0, int(np.log2(max(1, top // max(1, n)))))
        kind = np.uint8 if self.low_bits <= 8 else np.uint16 if self.low_bits <= 16 else np.uint32 if self.low_bits <= 32 else np.uint64
        values = values.astype(np.uint64)
        self.low = keep(f"{name}low", (values & np.uint64((1 << self.low_bits) - 1)).astype(kind))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        bits = np.zeros((int(high[-1]) if n else 0) + n + 1, bool)
        bits[high + np.arange(n)] = True
        words = np.packbits(np.r_[bits, np.zeros(-len(bits) % 64, bool)], bitorder="little").view(np.uint64)
        self.high = keep(f"{name}high", words)
        self.ones = keep(f"{name}ones", np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        at = np.asarray(at, np.int64)
        word = np.searchsorted(self.ones, at, "right") - 1
        left = at - self.ones[word]
        bits, place = np.asarray(self.high[word]), np.zeros(len(at), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # the (left+1)th one of each word, by halving
            low = bits & np.uint64((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            up = left >= count
            left = np.where(up, left - count, left)
            place += up * width
            bits = np.where(up, bits >> np.uint64(width), low)
        high = (word * 64 + place - at).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.low[at].astype(np.uint64)

    def successors(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self[mid] < x[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ones.nbytes


#: Probabilities are held as 16-bit steps of log10 from 0 down to this.
LOWEST = -20.0


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.round(np.clip(log10 / LOWEST, 0, 1) * 65534).astype(np.uint16) + np.uint16(1)


def dequantise(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.float64) - 1) / 65534 * LOWEST


class Trie:
    """Contexts (first level) and their successors (second level), with quantised probabilities.

    The second level holds each successor relative to its context: ids are offset by the context's place times the
    size of the id space, which makes one monotone sequence of all stretches. Pointers to the stretches are monotone.
    """

    def __init__(self, contexts: np.ndarray, successors: np.ndarray, probabilities: np.ndarray, space: int, folder: str | None = None):
        """Pairs sorted by context, then successor; probabilities as log10. With a folder, levels are files mapped to memory."""

        def keep(name, array):
            if folder is None or not array.nbytes:
                return array
            path = f"{folder}/{name}.bin"
            array.tofile(path)
            return np.memmap(path, array.dtype, "r")

        new = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(contexts) else np.array([], np.int64)
        self.space = np.uint64(space)
        self.contexts = EliasFano(contexts[new], keep, "contexts")
        self.pointers = EliasFano(np.r_[new, len(contexts)], keep, "pointers")
        rank = np.cumsum(np.r_[False, contexts[1:] != contexts[:-1]]) if len(contexts) else np.array([], np.int64)
        self.successors = EliasFano(rank.astype(np.uint64) * self.space + successors.astype(np.uint64), keep, "successors")
        self.codes = keep("codes", quantise(probabilities))

    def look_up(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The codes of these pairs, 0 for those that aren't there."""
        n = len(contexts)
        out = np.zeros(n, np.uint16)
        if not n or not self.contexts.n:
            return out
        distinct, which = np.unique(contexts.astype(np.uint64), return_inverse=True)
        place = self.contexts.successors(np.zeros(len(distinct), np.int64), np.full(len(distinct), self.contexts.n), distinct)
        found = np.flatnonzero(place < self.contexts.n)
        found = found[self.contexts[place[found]] == distinct[found]]
        there = np.zeros(len(distinct), bool)
        there[found] = True
        ok, at = np.flatnonzero(there[which]), place[which]
        lo, hi = self.pointers[at[ok]].astype(np.int64), self.pointers[at[ok] + 1].astype(np.int64)
        want = at[ok].astype(np.uint64) * self.space + successors[ok].astype(np.uint64)
        place = self.successors.successors(lo, hi, want)
        hit = place < hi
        hit[hit] = self.successors[place[hit]] == want[hit]
        out[ok[hit]] = self.codes[place[hit]]
        return out
