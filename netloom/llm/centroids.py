"""Centroid clustering of integer vectors with partial-distance search.

Vectors are rounded down to integers, so sums and distances are exact, and results don't hang on how rows are dealt. In
a round each task assigns its vectors and sums them by centroid; the sums, one row a centroid and dimension, are added
by Spark and become the next centroids. These are ``k`` vectors, which is all that the driver holds.

A vector's distance to a centroid accumulates over the dimensions of the largest variance first. After each stretch of
dimensions the centroids that are strictly farther than the best one so far are abandoned; those that are not go on
to the last dimension, so ties are seen and go to the smaller number.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import carried, whole
from .store import materialize

#: Dimensions after which distances are looked at.
STRETCHES = (8, 16, 32)
#: Rows that a task compares at once.
ROWS = 8_192
#: Bits of the parts in which sums over 64 bits travel.
PART = 40
LONG = (1 << 63) - 1


def narrow(dims: int) -> int:
    """Integers up to this size have squared distances within 64 bits; others are computed without a bound."""
    return 1 << ((60 - dims.bit_length()) // 2)


def to_integers(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of doubles; an array of Python's integers where some are not narrow."""
    if np.abs(x).max(initial=0) < narrow(x.shape[1]) / scale:
        return np.floor(x * scale).astype(np.int64)
    # from 2**60 on doubles are whole numbers, whose product with the scale may be beyond any double
    one = lambda v: int(v) * scale if abs(v) > 2.0**60 else int(np.floor(v * scale))
    return np.array([[one(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row of ``x``; dimensions are taken in ``order``.

    The first stretch is computed for all centroids. The one that is nearest by it is finished first, and its distance
    is the first to beat.
    """
    cuts = [0, *[s for s in STRETCHES if s < len(order)], len(order)]
    x, c = x[:, order], centroids[:, order]

    def part(rows, number, k):
        off = x[rows, cuts[k] : cuts[k + 1]] - c[number, cuts[k] : cuts[k + 1]]
        return (off * off).sum(axis=1)

    everything = slice(None)
    first = np.column_stack([part(everything, j, 0) for j in range(len(c))])
    number = first.argmin(axis=1) if first.dtype != object else np.array([min(range(len(c)), key=r.__getitem__) for r in first])
    best = first[np.arange(len(x)), number]
    for k in range(1, len(cuts) - 1):
        best = best + part(everything, number, k)
    for j in range(len(c)):
        rows = np.flatnonzero((first[:, j] <= best) & (number != j))
        d = first[rows, j]
        for k in range(1, len(cuts) - 1):
            if not len(rows):
                break
            d = d + part(rows, j, k)
            on = (d <= best[rows]).astype(bool)
            rows, d = rows[on], d[on]
        wins = ((d < best[rows]) | (j < number[rows])).astype(bool)
        best[rows[wins]], number[rows[wins]] = d[wins], j
    return number, best


def parts_of(total: int):
    """(place, part) of a whole number: its parts times 2**(PART * place) add up to it. A number of 62 bits is one part."""
    place = 0
    while abs(total) >> 62:
        yield place, total & ((1 << PART) - 1)
        total >>= PART
        place += 1
    yield place, total


def packed(row: list[int]) -> bytes:
    """Four bytes a component, or text, whose length is no multiple of four."""
    if max(map(abs, row)) <= narrow(len(row)):
        return np.array(row, "<i4").tobytes()
    body = b" ".join(b"%d" % v for v in row)
    return body + b" " * (len(body) % 4 == 0)


def unpacked(bodies: list[bytes], dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of integers): the narrow vectors, and the others."""
    numbers = np.fromiter((len(b) % 4 == 0 for b in bodies), bool, len(bodies))
    rows, wide = np.flatnonzero(numbers), np.flatnonzero(~numbers)
    out = [(rows, np.frombuffer(b"".join([bodies[i] for i in rows]), "<i4").reshape(-1, dims).astype(np.int64))] if len(rows) else []
    return out + ([(wide, np.array([[int(v) for v in bodies[i].split()] for i in wide], object))] if len(wide) else [])


def digest(row) -> str:
    return hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors that are kept.

    Kept are vectors of exactly ``dims`` components, none of them null or not finite; the rest get no row. The first
    centroids are those with the smallest hashes of ``seed`` and id; with fewer vectors than ``k`` there are fewer of
    them. Vectors without an id come last there, and vectors of one id by their components. Repeated rows are vectors of
    their own. A distance or a sum of distances that no 64 bits hold is null, though it counts as it is. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.transform(embedding, lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.coalesce((F.size(embedding) == dims) & F.forall(x, finite), F.lit(False))

    def pack(batches):
        for b in batches:
            ints = to_integers(np.stack(b["x"].to_list()), scale) if len(b) else np.zeros((0, dims), np.int64)
            bodies = [r.tobytes() for r in ints.astype("<i4")] if ints.dtype != object else [packed(r) for r in ints.tolist()]
            yield pd.DataFrame({"doc_id": b["doc_id"], "missing": b["missing"], "body": bodies})

    kept = vectors.where(usable).select(*carried(vec_id), x.alias("x")).mapInPandas(pack, "doc_id long, missing boolean, body binary")
    kept = materialize(kept, "integers")
    hashed = F.when(~F.col("missing"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256))
    seeds = [r["body"] for r in kept.orderBy(hashed.asc_nulls_last(), "body").limit(k).collect()]
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [None] * len(seeds)
    for rows, ints in unpacked(list(map(bytes, seeds)), dims):
        for i, v in zip(rows.tolist(), ints.tolist()):
            centroids[i] = v

    def moments(batches):
        n, one, two = 0, np.zeros(dims), np.zeros(dims)
        for b in batches:
            for _, ints in unpacked(b["body"].to_list(), dims):
                if ints.dtype == object:
                    continue  # the order of dimensions changes how soon centroids are abandoned, never which
                v = ints.astype(np.float64)
                n, one, two = n + len(v), one + v.sum(axis=0), two + (v * v).sum(axis=0)
        yield pd.DataFrame({"at": range(dims), "n": n, "one": one, "two": two})

    spread = kept.mapInPandas(moments, "at int, n long, one double, two double").groupBy("at").agg((F.try_divide(F.sum("two"), F.sum("n")) - F.pow(F.try_divide(F.sum("one"), F.sum("n")), F.lit(2))).alias("v"))
    spread = {r["at"]: r["v"] for r in spread.collect()}  # one row a dimension
    order = np.array(sorted(range(dims), key=lambda d: (-(spread[d] or 0.0), d)))

    def matrix(rows):
        wide = any(abs(v) > narrow(dims) for r in rows for v in r)
        return np.array(rows, object if wide else np.int64).reshape(len(rows), dims)

    def assigned(bodies, centres):
        for rows, ints in unpacked(bodies, dims):
            for top in range(0, len(rows), ROWS):
                some = ints[top : top + ROWS]
                mixed = object in (some.dtype, centres.dtype)
                yield rows[top : top + ROWS], some, *nearest(some.astype(object) if mixed else some, centres.astype(object) if mixed else centres, order)

    def totals(batches, rows):
        centres = matrix(rows)
        sums, counts = [[0] * dims for _ in rows], [0] * len(rows)
        for b in batches:
            for _, ints, number, _ in assigned(b["body"].to_list(), centres):
                for j in np.unique(number).tolist():
                    mine = ints[number == j]
                    counts[j] += len(mine)
                    sums[j] = [a + b for a, b in zip(sums[j], mine.sum(axis=0).tolist())]
        out = [(j, d, place, part, counts[j]) for j in range(len(rows)) if counts[j] for d in range(dims) for place, part in parts_of(sums[j][d])]
        yield pd.DataFrame(out, columns=["cluster", "at", "place", "part", "n"])

    for _ in range(rounds):
        found = kept.select("body").mapInPandas(functools.partial(totals, rows=centroids), "cluster int, at int, place int, part long, n long")
        added = found.groupBy("cluster", "at", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"), F.sum("n").alias("n")).collect()  # k centroids' worth
        sums, counts = {}, {}
        for r in added:
            sums[r["cluster"], r["at"]] = sums.get((r["cluster"], r["at"]), 0) + (int(r["part"]) << (PART * r["place"]))
            if r["place"] == 0:
                counts[r["cluster"]] = r["n"]
        centroids = [[sums[j, d] // counts[j] for d in range(dims)] if j in counts else old for j, old in enumerate(centroids)]

    def final(batches):
        centres = matrix(centroids)
        for b in batches:
            number, distance = np.zeros(len(b), np.int32), [0] * len(b)
            for rows, _, mine, far in assigned(b["body"].to_list(), centres):
                number[rows] = mine
                for i, d in zip(rows.tolist(), far.tolist()):
                    distance[i] = d
            fits = pd.array([d if d <= LONG else None for d in distance], "Int64")
            yield pd.DataFrame({"vec_id": whole(b["doc_id"], b["missing"]), "cluster": number, "distance": fits})

    placed = materialize(kept.mapInPandas(final, "vec_id long, cluster int, distance long"), "clusters")
    added = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count("*").alias("n"), F.count("distance").alias("some")).collect()  # k rows at most
    inertia = {r["cluster"]: int(r["d"]) if r["n"] == r["some"] else LONG + 1 for r in added}
    fits = lambda d: d if d <= LONG else None
    facts = [(j, fits(d), fits(sum(inertia.values())), digest(centroids[j])) for j, d in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
