"""SimHash near-duplicates through an inverted index of byte positions.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes. The index lists fingerprints under 8 sets of three byte positions (all triples within bytes 0-3 and
all within bytes 4-7): of any 5 positions, 3 lie in one half, so every pair to be found meets in some list. A list of
a single positional byte would hold a 256th of all fingerprints; one of three holds a 16-millionth. Pairs that meet
are tallied: those with at least 5 equal positional bytes remain, and are verified by their bits.

Equal fingerprints are one entry, whatever the number of documents. Lists of over ``block`` entries are dealt to
several groups, one for each pair of their blocks. What a group returns is a spanning forest of the pairs that it
verified, which keeps every connection and doesn't grow with the square of the list.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .ids import carried, whole
from .store import materialize

#: All triples of positions within each half of the 8 bytes; byte 0 is the lowest.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in itertools.combinations(half, 3)]
#: Pairs compared between one reduction to a forest and the next.
PAIRS_HELD = 1 << 20


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles (A-Z lowered, repeats included); 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], "<u8")
    return of_hashes(hashes)


def of_hashes(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of the 64-bit hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; a null text is an empty one."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(bytes(t), shingle) for t in b["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": whole(b["doc_id"], b["missing"]), "fp": fp})

    rows = docs.select(*carried(doc_id), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def _links(groups: pd.DataFrame, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the verified pairs within runs of equal (bucket, lo, hi)."""
    fp = groups["fp"].to_numpy().astype(np.uint64)
    if not len(fp):
        return fp, fp
    key = groups[["bucket", "lo", "hi"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    last = np.repeat(np.r_[starts[1:], len(fp)], np.diff(np.r_[starts, len(fp)]))  # end of the run of each row
    a, b, held = [], [], 0
    at, step = np.arange(len(fp)), 1
    while True:
        at = at[at + step < last[at]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + step]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = np.flatnonzero(shared >= 8 - max_bits)
        near = near[np.bitwise_count(x[near]) <= max_bits]
        a.append(fp[at[near]])
        b.append(fp[at[near] + step])
        held += len(near)
        if held > PAIRS_HELD:
            u, v = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [u], [v], 0
        step += 1
    return forest(np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(fps: DataFrame, max_bits: int = 3, block: int = 4096) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints ``fps`` (fp long) that differ in at most ``max_bits`` (3 at most) bits and connect all that such pairs connect."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the lists guarantee pairs of at most 3 differing bits")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(i << 24).cast("long") + byte(p) * 65536 + byte(q) * 256 + byte(r) for i, (p, q, r) in enumerate(TRIPLES)]
    index = fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    long = materialize(index.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("k")), "lists")
    if not long.isEmpty():
        mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        pairs = index.join(long, "bucket", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        index = pairs.select("bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    else:
        index = index.select("bucket", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp")

    def run(batches):
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rows[["bucket", "lo", "hi"]].to_numpy()
            cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1] + 1) if len(rows) and (key != key[-1]).any() else 0
            rest = rows.iloc[cut:]  # the last run may go on in the next batch
            a, b = _links(rows.iloc[:cut], max_bits)
            yield pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})
        if rest is not None:
            a, b = _links(rest, max_bits)
            yield pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the smallest id reachable through links.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows appear as often as they come. A
    null id is never the smallest, unless its component has no other (then the component's id is null). An empty table
    gives an empty result; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = connected_components(links(groups.select("fp"), max_bits))
    placed = materialize(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    least = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    where = materialize(placed.join(least, "root").select("fp", "component_id"), "where")
    return rows.join(where, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
