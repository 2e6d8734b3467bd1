"""Near-duplicates by the Jaccard similarity of word shingles: every pair at ``least`` or more is connected.

1. The SimHash operator proposes: sets whose fingerprints differ in at most 3 bits, through its index of byte positions.
   Proposals are verified on the sets themselves, here and below.
2. Lists complete it. Order all shingles in any one way. Two sets with a similarity of t or more share one of the first
   n - ceil(t n) + 1 shingles of each (n is the size of the set), so lists of the sets under these shingles bring every
   such pair together. Sizes, places in the order, and the parities of ``PARITIES`` cells that the shingles fall into
   bound the similarity of a pair from above and drop most of those under t. Shingles that a bounded sample of the texts
   repeats come last in the order; this keeps lists short and is no part of the result.
3. Neighbours in a list are verified first; then, in lists whose members aren't all connected by now, all pairs of
   different components that the bounds leave.

Equal sets are one entry, whatever the number of documents. A group of near copies costs a number of pairs in proportion
to its size, as its members are connected before all pairs are looked at; what is compared in full are pairs which the
bounds can't tell from similar ones, and of these every one. Long lists are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .store import drop, materialize
from .words import hashes, mix, tokenized, window_hashes

#: Texts whose repeated shingles come last in the order, at most about; and how many such shingles are held.
SAMPLE, COMMON = 20_000, 1 << 19
#: Members of a list that one group of a task holds; neighbours are sought in segments of so many.
BLOCK, SEGMENT = 1_024, 256
#: Neighbours of a member that are verified before all pairs are looked at.
NEIGHBOURS = 3
#: Cells whose parities bound the difference of two sets.
PARITIES = 512
#: Pairs of a list that are compared at once.
PAIRS_HELD = 1 << 18
#: Texts whose words are held at once.
PART = 512
EPS = 1e-9


def shingle_sets(texts: list[bytes], shingle: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles (A-Z lowered); a shorter text is one shingle, one without words has none."""
    if len(texts) > PART:
        return [s for i in range(0, len(texts), PART) for s in shingle_sets(texts[i : i + PART], shingle)]
    table, codes, counts = tokenized([t.lower() for t in texts])
    h = hashes(table, 42)[codes] if len(codes) else np.array([], np.uint64)
    ends = np.cumsum(counts)
    whole = window_hashes(h, shingle, 0x9E3779B97F4A7C15)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= shingle:
            out.append(np.unique(whole[end - n : end - shingle + 1]))
        else:
            out.append(mix(window_hashes(h[end - n : end], n, 0xC2B2AE3D27D4EB4F)) if n else h[:0])
    return out


def _text(text: str):
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def _common(docs: DataFrame, text: str, shingle: int, sample: int) -> np.ndarray:
    """Shingles that several of the sampled texts have, commonest last."""
    share = min(1.0, sample / max(1, docs.count()))
    drawn = docs.select(_text(text).alias("text")).where(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        for b in batches:
            sets = shingle_sets([bytes(t) for t in b["text"]], shingle)
            yield pd.DataFrame({"s": np.concatenate(sets).astype(np.int64) if sets else np.array([], np.int64)})

    seen = drawn.distinct().mapInPandas(run, "s long").groupBy("s").count().where("count > 2")
    return np.array([r["s"] for r in seen.orderBy(F.desc("count"), "s").limit(COMMON).collect()][::-1], np.int64).astype(np.uint64)


def _parities(s: np.ndarray) -> np.ndarray:
    """Whether each cell holds an odd number of the shingles, as 64-bit words."""
    odd = np.bincount((s % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(index: DataFrame) -> DataFrame:
    """(list, segment, id, n, left): lists of two and more sets; ``left`` elements of the set follow the shared one, itself included.

    Lists of the same members are one (under the sum of their hashed ids), with the largest ``left`` of each. A segment
    ends with the member that the next one begins with.
    """

    def run(batches):
        rest, open_, held = None, None, 0  # the shingle of a list that has been given out in part, and members given out

        def given(rows: pd.DataFrame, last: bool):
            nonlocal open_, held
            s, ids = rows["s"].to_numpy(), rows["id"].to_numpy()
            if not len(s):
                return None
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[starts, len(s)])
            of = np.repeat(np.arange(len(starts)), size)
            place = np.arange(len(s)) - starts[of]
            name = np.add.reduceat(mix(ids.astype(np.uint64)), starts)[of]
            go_on = s == open_ if open_ is not None else np.zeros(len(s), bool)
            part = go_on if last else go_on | (s == s[-1])
            name = np.where(part, mix(s.astype(np.uint64) ^ np.uint64(0x5555555555555555)), name)
            place = np.where(go_on, place + held, place)
            if not last:
                open_, held = s[-1], int(place[-1]) + 1
            ok = (size[of] > 1) | part
            out = pd.DataFrame({"list": name.astype(np.int64), "segment": place // SEGMENT, "id": ids, "n": rows["n"].to_numpy(), "left": (rows["n"] - rows["place"]).to_numpy()})[ok]
            again = out[(place[ok] % SEGMENT == 0) & (place[ok] > 0)]
            return pd.concat([out, again.assign(segment=again["segment"] - 1)])

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            s = rows["s"].to_numpy()
            cut = int(np.searchsorted(s, s[-1])) if len(s) else 0
            if len(s) - cut > 16 * BLOCK:  # too long to be held: given out in part
                out, rest = given(rows, False), None
            else:
                out, rest = given(rows.iloc[:cut], True), rows.iloc[cut:]
            if out is not None:
                yield out
        if rest is not None and (out := given(rest, True)) is not None:
            yield out

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = index.repartition(n, "s").sortWithinPartitions("s", "n", "id").mapInPandas(run, "list long, segment int, id long, n int, left int")
    return found.groupBy("list", "segment", "id").agg(F.max("n").alias("n"), F.max("left").alias("left"))


def _possible(a: Column, b: Column, least: float) -> Column:
    """Whether sizes and parities let two sets (structs) be as similar as asked."""
    apart = F.aggregate(F.zip_with(a["parities"], b["parities"], lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.least(a["n"], b["n"]) >= least * F.greatest(a["n"], b["n"]) - EPS) & (apart <= (1 - least) / (1 + least) * (a["n"] + b["n"]) + EPS)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _neighbours(lists: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: sets near each other in a list, in different components, that the bounds leave."""
    me = F.struct("id", "n", "left", "parities", "root")
    order = Window.partitionBy("list", "segment").orderBy("n", "id")
    rows = lists.select(me.alias("x"), F.array(*[F.lag(me, k).over(order) for k in range(1, NEIGHBOURS + 1)]).alias("before")).select("x", F.explode("before").alias("y"))
    rows = rows.where("x.root <> y.root").where(F.least("x.left", "y.left") >= least / (1 + least) * (F.col("x.n") + F.col("y.n")) - EPS)
    return rows.where(_possible(F.col("x"), F.col("y"), least)).select(*_pair("x.id", "y.id")).distinct()


def _group_pairs(rows: pd.DataFrame, least: float) -> Iterator[pd.DataFrame]:
    """(a, b), a < b: pairs that the bounds leave within whole groups (list, lo, hi), sorted by ``mine``: of the parts lo and hi, or within the one where these are the same.

    Groups are many and small, so the pairs of all of them are made at once, up to ``PAIRS_HELD`` or those of one member.
    """
    if not len(rows):
        return
    ids, root, n, left, mine, lo, hi = (rows[c].to_numpy() for c in ("id", "root", "n", "left", "mine", "lo", "hi"))
    key = rows[["list", "lo", "hi"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    size = np.diff(np.r_[starts, len(rows)])
    end = np.repeat(starts + size, size)
    at = np.arange(len(rows))
    second = np.repeat(starts + np.add.reduceat(mine != hi, starts), size)  # where the part hi begins
    begin = np.where(lo == hi, at + 1, np.where(mine == lo, second, end))
    upto = np.r_[0, np.cumsum(end - begin)]
    words, i = None, 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS_HELD, "right")) - 1)
        u = np.repeat(at[i:j], (end - begin)[i:j])
        v = np.arange(upto[j] - upto[i]) + np.repeat(begin[i:j] - (upto[i:j] - upto[i]), (end - begin)[i:j])
        i = j
        ok = (root[u] != root[v]) & (np.minimum(n[u], n[v]) >= least * np.maximum(n[u], n[v]) - EPS)
        u, v = u[ok], v[ok]
        ok = np.minimum(left[u], left[v]) >= least / (1 + least) * (n[u] + n[v]) - EPS
        u, v = u[ok], v[ok]
        if len(u):
            words = np.stack(rows["parities"].to_list()).astype(np.int64).view(np.uint64) if words is None else words
            near = np.bitwise_count(words[u] ^ words[v]).sum(axis=1, dtype=np.int64) <= (1 - least) / (1 + least) * (n[u] + n[v]) + EPS
            a, b = ids[u[near]], ids[v[near]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _rest(lists: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of different components within a list that the bounds leave.

    A list's largest component needs no comparison within: it's dealt to ``k`` parts, the other members to ``m``, and
    each pair of parts that may hold a pair of different components is a group of its own.
    """
    members = lists.groupBy("list", "root", "id").agg(F.max("n").alias("n"), F.max("left").alias("left"), F.any_value("parities").alias("parities"))
    members = materialize(members, "members")
    sizes = members.groupBy("list", "root").count().groupBy("list").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select(F.col("list").alias("of"), F.col("top.root").alias("top"), parts(F.col("top.count")).alias("k"), parts(F.col("all") - F.col("top.count")).alias("m"))
    rows = members.join(sizes, F.col("list") == F.col("of"))
    k, m, upto = F.col("k"), F.col("m"), lambda n: F.sequence(F.lit(0), n - 1)
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    rows = rows.withColumn("mine", F.when(F.col("root") == F.col("top"), part(k)).otherwise(k + part(m)))
    others = F.when(F.col("mine") < k, F.transform(upto(m), lambda j: k + j)).otherwise(upto(k + m))
    rows = rows.withColumn("other", F.explode(others)).select("list", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "root", "n", "left", "parities")

    def run(batches):
        rest = None
        for batch in batches:
            held = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = held[["list", "lo", "hi"]].to_numpy()
            cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1] + 1) if len(held) and (key != key[-1]).any() else 0
            rest = held.iloc[cut:]  # the last group may go on in the next batch
            yield from _group_pairs(held.iloc[:cut], least)
        if rest is not None and len(rest):
            yield from _group_pairs(rest, least)

    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "list", "lo", "hi").sortWithinPartitions("list", "lo", "hi", "mine").mapInPandas(run, "a long, b long").distinct()
    return found


def _proposed(sets: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: sets that the fingerprints connect and the bounds leave, no more than there are sets and links."""
    one = sets.select("fp", F.struct("id", "n", "parities").alias("x"))
    reps = materialize(one.groupBy("fp").agg(F.min("x").alias("y")), "fingerprints")
    same = one.join(reps, "fp").where("x.id <> y.id").select("x", "y")
    of = lambda c, name: reps.select(F.col("fp").alias(c), F.col("y").alias(name))
    far = simhash.links(reps.select("fp")).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    return same.unionAll(far).where(_possible(F.col("x"), F.col("y"), least)).select(*_pair("x.id", "y.id")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs`` whose sets are as similar as asked."""

    def run(batches):
        for batch in batches:
            x, y = (shingle_sets([bytes(t) for t in batch[c]], shingle) for c in ("x", "y"))
            both = np.array([len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y)], np.int64)
            any_ = np.array([len(u) + len(v) for u, v in zip(x, y)], np.int64) - both
            yield batch.loc[both >= least * any_ - EPS, ["a", "b"]]

    of = lambda c, name: texts.select(F.col("id").alias(c), F.col("text").alias(name))
    return materialize(pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long"), "found")


def marked(docs: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8, sample: int = SAMPLE) -> DataFrame:
    """``docs``, ``__row``, a number of each row, and ``__near``: a number that two rows share if pairs of a similarity of ``least`` or more connect them. A stored table.

    Null and empty texts are near each other only. Texts under ``shingle`` words are near those of the same words.
    Repeated rows stay; an empty table gives an empty result; other columns are carried, whatever their names.
    """
    common = _common(docs, text, shingle, sample)

    @F.pandas_udf("id long, n int, fp long, parities array<long>, first array<long>")
    def described(texts: pd.Series) -> pd.DataFrame:
        order, out = np.argsort(common), []
        known = common[order]
        for s in shingle_sets([bytes(t) for t in texts], shingle):
            n = len(s)
            rank = np.zeros(n, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                rank = np.where(known[at] == s, order[at] + 1, 0)
            first = s[np.argsort(rank, kind="stable")[: n - int(np.ceil(least * n - EPS)) + 1]] if n else s
            out.append((xxhash.xxh64_intdigest(s.tobytes(), n), n, simhash.of_hashes(s), _parities(s), first.astype(np.int64)))
        ids, n, fp, parities, first = zip(*out) if out else [()] * 5
        signed = lambda x: np.array(x, np.uint64).astype(np.int64)
        return pd.DataFrame({"id": signed(ids), "n": np.array(n, np.int32), "fp": signed(fp), "parities": list(parities), "first": list(first)})

    rows = materialize(docs.withColumn("__set", described(_text(text))), "sets")
    one = rows.select("__set.*").groupBy("id")
    sets = materialize(one.agg(*[F.any_value(c).alias(c) for c in ("n", "fp", "parities")]), "one")
    index = one.agg(F.any_value("n").alias("n"), F.any_value("first").alias("first")).select("id", "n", F.posexplode("first").alias("place", "s"))
    lists = materialize(_lists(index), "lists")
    pairs = materialize(_proposed(sets, least), "pairs")
    nodes = lists.select("id").union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = rows.select(F.col("__set.id").alias("id"), _text(text).alias("text")).join(nodes, "id", "left_semi")
    texts = materialize(texts.groupBy("id").agg(F.any_value("text").alias("text")), "texts")
    found = _verified(pairs, texts, shingle, least)

    def rooted() -> DataFrame:
        roots = connected_components(found).withColumnRenamed("node", "id")
        return lists.join(sets.select("id", "parities"), "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))

    near = materialize(_neighbours(rooted(), least).join(pairs, ["a", "b"], "left_anti"), "pairs")
    found = found.unionAll(_verified(near, texts, shingle, least))
    rest = materialize(_rest(rooted(), least).join(pairs.unionAll(near), ["a", "b"], "left_anti"), "pairs")
    found = found.unionAll(_verified(rest, texts, shingle, least))
    roots = connected_components(found).select(F.col("node").alias("__id"), F.col("root").alias("__root"))
    drop(lists, sets, texts, pairs, near, rest)
    out = rows.join(roots, F.col("__set.id") == F.col("__id"), "left").withColumn("__near", F.coalesce("__root", "__set.id")).drop("__set", "__id", "__root")
    out = materialize(out.withColumn("__row", F.monotonically_increasing_id()), "near")
    drop(rows)
    return out
