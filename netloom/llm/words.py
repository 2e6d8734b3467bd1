"""Words of texts as arrays. A word is a run of bytes other than space and \\x09-\\x0D, which is where bytes.split() splits."""

from __future__ import annotations

import numpy as np
import xxhash


def tokenized(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, number of each word of all texts, number of words of each text)."""
    table: dict[bytes, int] = {}
    add = table.setdefault
    codes, counts = [], []
    for t in texts:
        words = t.split()
        counts.append(len(words))
        codes.append(np.fromiter((add(w, len(table)) for w in words), np.int64, len(words)))
    return list(table), np.concatenate(codes) if codes else np.array([], np.int64), np.array(counts, np.int64)


def hashes(words: list[bytes], seed: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all their bits (one-to-one)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(word_hash: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of each run of ``size`` words of the sequence of word hashes."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.array([], np.uint64)
    out, f = np.zeros(n, np.uint64), np.uint64(factor)
    for j in range(size):
        out *= f
        out += word_hash[j : j + n]
    return mix(out)
