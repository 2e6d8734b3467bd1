"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes, largest first. A k-d tree over these axes, grown on a bounded sample,
deals all vectors to leaves, and leaves to tiles. Pairs of leaves whose bounding boxes are too far apart for the
threshold are never compared. Within a pair of tiles, products accumulate over the leading dimensions first; the rest
of a product is at most the product of both suffix norms, and comparison stops when no pair can reach the threshold.

Tiles that follow each other in the tree form blocks. A task gets two blocks and compares their tiles, so a tile is
sent once for each partner of its block instead of once for each partner of its own.

Equal vectors are one entry with a count; they are told by 128 bits of two hashes, which two different ones of 10^11
vectors share with a probability of 10^-16. A pair of tiles returns link counts and a spanning forest of its links, both
linear in the tiles' rows however many pairs link.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import connected_components, forest
from .store import materialize

#: Vectors that the axes and the tree are fitted on, at most about; every vector is compared whatever the sample.
SAMPLE = 20_000
#: Rows of a tile for vectors of up to 64 dimensions (less for longer ones), and leaves of the tree, at most.
TILE, LEAVES = 4_096, 1_024
#: Tiles of a block, at most, and blocks that there are at least. A task compares two blocks.
TILES, BLOCKS = 16, 6
#: Leading dimensions after which products are looked at.
STEPS = (16, 32)
#: Cosines this near the threshold are computed again from the vectors as given.
CLOSE = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the direction of the largest share of the squared lengths first."""
    _, basis = np.linalg.eigh(vectors.T @ vectors)
    return basis[:, ::-1]


def grow(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """A k-d tree as (axis, value, left, right); a negative child is leaf -1 - child. Splits the fullest leaf at the median of its widest axis."""
    tree: list = []
    parts = [(np.arange(len(points)), None)]
    done = 0
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: len(parts[i][0]))
        rows, parent = parts[k]
        if len(rows) < 2:
            break
        axis = int(np.argmax(points[rows].std(axis=0)))
        value = float(np.median(points[rows, axis]))
        left = points[rows, axis] < value
        if not left.any():
            break
        node = len(tree)
        tree.append([axis, value, None, None])
        if parent is not None:
            tree[parent[0]][parent[1]] = node
        parts[k] = (rows[left], (node, 2))
        parts.append((rows[~left], (node, 3)))
    for _, parent in parts:
        if parent is not None:
            tree[parent[0]][parent[1]] = -1 - done
        done += 1
    return [tuple(x) for x in tree]


def leaf_of(tree: list, points: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))] if tree else []
    while todo:
        node, rows = todo.pop()
        axis, value, left, right = tree[node]
        low = points[rows, axis] < value
        for child, part in ((left, rows[low]), (right, rows[~low])):
            if child < 0:
                out[part] = -1 - child
            elif len(part):
                todo.append((child, part))
    return out


def suffixes(y: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Where products are looked at, and for each place the norm of what follows in every row."""
    steps = [s for s in STEPS if s < y.shape[1]] + [y.shape[1]]
    return steps, [np.sqrt((y[:, s:] ** 2).sum(axis=1)) for s in steps]


def compare(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, count_a: np.ndarray, count_b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray):
    """(links of a's rows, of b's rows, forest as places in a and in b + len(a)) of two tiles of rotated unit vectors.

    ``bound`` is, for all pairs, the product of the leading dimensions and of what the rest can add: each step adds
    the products of its dimensions and puts its own suffix norms for those of the step before. It is kept in single
    precision, with the most that this can err as slack; pairs that it leaves are computed in double precision.
    """
    dims = a.shape[1]
    steps, rest_a = suffixes(a)
    _, rest_b = suffixes(b)
    slack = CLOSE + (dims + 4 * len(steps)) * 2.0**-21
    left, right, before = [], [], 0
    for k, s in enumerate(steps):
        swap = [[rest_a[k]], [rest_b[k]]] if k == 0 else [[rest_a[k], -rest_a[k - 1]], [rest_b[k], rest_b[k - 1]]]
        left.append(np.column_stack([a[:, before:s], *swap[0]]).astype(np.float32))
        right.append(np.column_stack([b[:, before:s], *swap[1]]).astype(np.float32).T)
        before = s
    links_a, links_b, us, vs, held = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), [], [], 0
    for top in range(0, len(a), 256):
        part = slice(top, min(top + 256, len(a)))
        bound, i, j = None, None, None
        for k, s in enumerate(steps):
            bound = left[k][part] @ right[k] if k == 0 else bound + left[k][part] @ right[k]
            alive = bound >= threshold - slack
            n = int(np.count_nonzero(alive))
            if not n or s == dims or n < 0.01 * alive.size:
                i, j = np.divmod(np.flatnonzero(alive), len(b))
                i = i + top
                break
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        p, before = np.zeros(len(i)), 0
        for k, s in enumerate(steps):
            p = p + np.einsum("ij,ij->i", a[i, before:s], b[j, before:s])
            ok = p + rest_a[k][i] * rest_b[k][j] >= threshold - CLOSE
            i, j, p, before = i[ok], j[ok], p[ok], s
        near = np.flatnonzero(np.abs(p - threshold) <= CLOSE)
        if len(near):
            x, y = raw_a[i[near]], raw_b[j[near]]
            p[near] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        i, j = i[p >= threshold], j[p >= threshold]
        links_a += np.bincount(i, count_b[j], minlength=len(a)).astype(np.int64)
        links_b += np.bincount(j, count_a[i], minlength=len(b)).astype(np.int64)
        us.append(i)
        vs.append(j if same else j + len(a))
        held += len(i)
        if held > 1 << 20:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
    u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (np.array([], np.int64),) * 2
    return links_a, links_b, u, v


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    A vector that is null, empty, zero, or holds null or non-finite components links with nothing, nor does one without
    an id, nor vectors of different lengths with each other. Repeated rows are vectors of their own and link. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.transform(embedding, lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.coalesce(F.col(vec_id).isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0.0), F.lit(False))
    single = vectors.schema[embedding].dataType == ArrayType(FloatType(), vectors.schema[embedding].dataType.containsNull)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable, x).alias("x"))
    hashes = F.struct(F.xxhash64("x").alias("one"), F.xxhash64(F.lit(7), F.size("x"), F.reverse("x")).alias("two"))
    rows = materialize(rows.withColumn("hash", F.when(F.col("x").isNotNull(), hashes)), "vectors")
    classes = rows.where("hash is not null").groupBy("hash").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("x").alias("x"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # written once, so numbers stay
    sizes = {r["d"]: r["count"] for r in classes.groupBy(F.size("x").alias("d")).count().collect()}
    made = [_links(spark, classes.where(F.size("x") == d), d, n, threshold, single) for d, n in sorted(sizes.items())]
    found = made[0] if made else spark.createDataFrame([], "class long, links long, other long")
    for m in made[1:]:
        found = found.unionAll(m)
    found = materialize(found, "links")
    roots = connected_components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    placed = classes.select("class", "hash", "least", "n").join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    placed = materialize(placed.select("hash", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")), "placed")
    least = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    where = materialize(placed.join(least, "root").select("hash", "n_links", "component_id"), "where")
    out = rows.select("vec_id", "hash").join(where, "hash", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(spark, classes: DataFrame, dims: int, n: int, threshold: float, single: bool) -> DataFrame:
    """(class, links, other): link counts (other null), and edges of spanning forests (links 0)."""
    kind = np.dtype("<f4" if single else "<f8")
    share = min(1.0, SAMPLE / n)
    drawn = classes.where(F.pmod(F.xxhash64(F.lit(3), "hash"), F.lit(1 << 30)) < max(1, int(share * (1 << 30)))).select("x").toPandas()["x"]
    points = _unit(np.stack(drawn.to_list()).astype(np.float64)) if len(drawn) else np.eye(dims)
    basis = axes(points)
    tile = max(64, TILE * 64 // max(dims, 64))
    tree = grow(points @ basis, int(np.clip(-(-n // int(np.clip(n // 24, 256, tile))), 1, LEAVES)))

    def deal(batches):
        for b in batches:
            raw = np.stack(b["x"].to_list()).astype(np.float64)
            yield pd.DataFrame({"leaf": leaf_of(tree, _unit(raw) @ basis), "class": b["class"], "n": b["n"], "raw": [r.tobytes() for r in raw.astype(kind)]})

    dealt = materialize(classes.select("class", "n", "x").mapInPandas(deal, "leaf long, class long, n long, raw binary"), "dealt")
    counts = {r["leaf"]: r["count"] for r in dealt.groupBy("leaf").count().collect()}  # LEAVES rows at most
    parts, first, total = {}, {}, 0
    for leaf in sorted(counts):
        parts[leaf], first[leaf] = -(-counts[leaf] // tile), total
        total += parts[leaf]
    tiles_a_block = int(np.clip(-(-total // BLOCKS), 1, TILES))
    of_leaf = lambda d: F.element_at(F.map_from_arrays(F.array(*map(F.lit, d)), F.array(*map(F.lit, d.values()))), F.col("leaf"))
    tiled = dealt.withColumn("tile", of_leaf(first) + F.pmod(F.xxhash64("class"), of_leaf(parts)))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class")
        body = b"".join(rows["raw"])
        y = _unit(np.frombuffer(body, kind).reshape(-1, dims).astype(np.float64)) @ basis
        return pd.DataFrame([(*key, body, rows["class"].to_numpy(np.int64).tobytes(), rows["n"].to_numpy(np.int64).tobytes(), y.min(axis=0), y.max(axis=0))], columns=["leaf", "tile", "raw", "ids", "ns", "low", "high"])

    tiles = tiled.groupBy("leaf", "tile").applyInPandas(packed, "leaf long, tile long, raw binary, ids binary, ns binary, low array<double>, high array<double>")
    tiles = materialize(tiles.withColumn("block", F.expr(f"tile div {tiles_a_block}")), "tiles")
    sides = tiles.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("at", "side"))
    sides = sides.groupBy("leaf", "at").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
    boxes = sides.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("box")).orderBy("leaf").collect()  # LEAVES rows at most
    order = [r["leaf"] for r in boxes]
    low, high = (np.array([[side[end] for side in r["box"]] for r in boxes]) for end in ("low", "high"))
    near = lambda lo, hi, los, his: (np.maximum(0, np.maximum(los - hi, lo - his)) ** 2).sum(axis=-1) <= 2 - 2 * threshold + CLOSE
    partners = [(leaf, order[k + j]) for k, leaf in enumerate(order) for j in np.flatnonzero(near(low[k], high[k], low[k:], high[k:])).tolist()]
    blocks = tiles.select("leaf", "block").distinct()
    pairs = spark.createDataFrame(partners, "la long, lb long")
    pairs = pairs.join(blocks.select(F.col("leaf").alias("la"), F.col("block").alias("a")), "la").join(blocks.select(F.col("leaf").alias("lb"), F.col("block").alias("b")), "lb")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    both = tiles.join(ends, "block").select("a", "b", "block", "tile", "raw", "ids", "ns")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = []
        for r in rows.sort_values("tile").itertuples():
            raw = np.frombuffer(r.raw, kind).reshape(-1, dims).astype(np.float64)
            y = _unit(raw) @ basis
            held.append((r.block, np.frombuffer(r.ids, np.int64), np.frombuffer(r.ns, np.int64), raw, y, y.min(axis=0), y.max(axis=0)))
        out = []
        for p, (block_a, ids_a, ns_a, raw_a, a, low_a, high_a) in enumerate(held):
            for q, (block_b, ids_b, ns_b, raw_b, b, low_b, high_b) in enumerate(held[p:], p):
                if (block_a, block_b) != key or not near(low_a, high_a, low_b, high_b):
                    continue
                ca, cb, u, v = compare(a, b, threshold, p == q, ns_a, ns_b, raw_a, raw_b)
                every, count = (ids_a, ca + cb) if p == q else (np.concatenate([ids_a, ids_b]), np.concatenate([ca, cb]))
                some = np.flatnonzero(count)
                out.append(pd.DataFrame({"class": np.r_[every[some], every[u]], "links": np.r_[count[some], np.zeros(len(u), np.int64)], "other": pd.array([*[None] * len(some), *every[v].tolist()], "Int64")}))
        return pd.concat(out) if out else pd.DataFrame({"class": [], "links": [], "other": pd.array([], "Int64")})

    return both.groupBy("a", "b").applyInPandas(run, "class long, links long, other long")
