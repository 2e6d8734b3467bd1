"""Merkle manifest of a dataset: a digest for each row, each source and the whole, and a proof for each row.

Rows of a source, in the order of their ids, are the leaves of a tree; every ``ARITY`` consecutive nodes have a parent. The
roots of the sources are the leaves of one more tree. How many children a parent has follows from its place and from the
number of leaves alone, so a parent can tell by itself when it is complete.

Leaves lie in ranges, so nearly all parents find their children within one partition: each child is an event for its
parent, a parent that has them all is hashed at once, and is itself an event for its own parent. What stays incomplete
at the edges of partitions is the frontier. It is shuffled with combineByKey, which puts partial parents together, by
an ancestor some levels up, so that parents go on completing each other there. Complete parents keep their children,
and proofs follow these links from the root down to the runs of leaves.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, materialize

ARITY = 16
#: Levels that a shuffle of the frontier brings together.
LEVELS = 4
#: Number of the tree over the sources; those of the sources count from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARENT = "tree long, level int, at long, size long, top long, places array<int>, digests array<string>, digest string, head boolean"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values one after the other: ``-`` for a missing one, else its length in bytes, a colon, and itself."""
    field = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[field(v.cast("string")) for v in values]).cast("binary"), 256)


def ranges(rows: DataFrame, group: str, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` written in the order of ``group`` (null first) and ``order``, and the spans of groups in their partitions.

    The rows get __part and __row; the spans are (group, part, first, earlier, size): the least __row, the number of the
    group's rows in partitions before, and in all. A group may span any number of partitions.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__row", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("__part", F.shiftright("__row", 33)), name)
    some = ranged.groupBy(F.col(group).alias("group"), F.col("__part").alias("part")).agg(F.min("__row").alias("first"), F.count("*").alias("n"))
    one = Window.partitionBy("group")
    earlier = F.sum("n").over(one.orderBy("part")) - F.col("n")
    return ranged, some.select("group", "part", "first", earlier.alias("earlier"), F.sum("n").over(one).alias("size"))


def placed(ranged: DataFrame, spans: DataFrame, group: str) -> DataFrame:
    """The rows and columns of both, with ``at``, the place of a row in its group. Each key is within one partition's rows, so none is hot."""
    both = ranged.join(spans, ranged[group].eqNullSafe(spans["group"]) & (ranged["__part"] == spans["part"]))
    return both.withColumn("at", F.col("earlier") + F.col("__row") - F.col("first"))


def shape(level: int, at: int, size: int) -> tuple[int, bool]:
    """(children of the node ``at`` of a level above the leaves, whether that level has no other node) in a tree of ``size`` leaves."""
    below = size
    for _ in range(level - 1):
        below = -(-below // ARITY)
    return min(ARITY, below - ARITY * at), below <= ARITY


def above(tree: int, level: int, at: int, size: int, top: int, last: bool):
    """((tree, level, at, size, top), place) of a node's parent; None for the root of all."""
    if not last:
        return (tree, level + 1, at // ARITY, size, top), at % ARITY
    if tree == TOP or top == 1:
        return None
    return (TOP, 1, tree // ARITY, top, top), tree % ARITY


def climb(events):
    """Complete parents as (key, children, digest), then incomplete ones with digest None, of (key, {place: digest}) events."""
    waiting: dict = {}
    for key, children in events:
        while True:
            held = waiting.setdefault(key, {})
            held.update(children)
            tree, level, at, size, top = key
            arity, last = shape(level, at, size)
            if len(held) < arity:
                break
            del waiting[key]
            run = [held[i] for i in range(arity)]
            digest = hashlib.sha256("".join(run).encode()).hexdigest()
            yield key, held, digest
            up = above(tree, level, at, size, top, last)
            if up is None:
                break
            key, children = up[0], {up[1]: digest}
    for key, held in waiting.items():
        yield key, held, None


def _row(key, held, digest):
    places = sorted(held)
    return (*key, places, [held[p] for p in places], digest, shape(key[1], key[2], key[3])[1])


def parents(leaves: DataFrame) -> DataFrame:
    """All parents, with their children in order, from ``leaves`` (tree, at, size, top, leaf)."""
    spark = leaves.sparkSession

    def events(batches):
        for b in batches:
            for tree, at, size, top, leaf in zip(*(b[c].tolist() for c in ("tree", "at", "size", "top", "leaf"))):
                if up := above(tree, 0, at, size, top, size == 1):
                    yield up[0], {up[1]: leaf}

    def first(batches):
        made = climb(events(batches))
        while rows := [_row(*x) for x in itertools.islice(made, 4_096)]:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARENT.split(", ")])

    turns = [materialize(leaves.select("tree", "at", "size", "top", "leaf").mapInPandas(first, PARENT), "parents")]
    while not (frontier := turns[-1].where("digest is null")).isEmpty():
        reach = LEVELS * len(turns)
        partials = frontier.rdd.map(lambda r: ((r.tree, r.level, r.at, r.size, r.top), dict(zip(r.places, r.digests))))
        ancestor = lambda k, reach=reach: hash((k[0], max(reach, k[1]), k[2] // ARITY ** max(0, reach - k[1])))
        together = partials.combineByKey(dict, operator.or_, operator.or_, partitionFunc=ancestor)
        turns.append(materialize(spark.createDataFrame(together.mapPartitions(lambda part: (_row(*x) for x in climb(part))), PARENT), "parents"))
    out = materialize(functools.reduce(DataFrame.unionAll, turns).where("digest is not null"), "tree")
    drop(*turns)
    return out


def step(place: Column) -> Column:
    """What stands in front of a child, and behind it, among the ``digests`` of its parent, as text."""
    return F.struct(F.array_join(F.slice("digests", 1, place), "").alias("before"), F.array_join(F.slice("digests", place + 2, ARITY), "").alias("after"))


def under(paths: DataFrame, below: DataFrame) -> DataFrame:
    """The rows of ``below`` (tree, at, …) with the ``up``, subroot and root of their parent's of ``paths``, its own step in front."""
    over = paths.select(F.col("tree").alias("__tree"), F.col("at").alias("__at"), "digests", "up", "subroot", "root")
    both = below.join(over, (F.col("tree") == F.col("__tree")) & (F.expr(f"at div {ARITY}") == F.col("__at")))
    return both.withColumn("up", F.concat(F.array(step((F.col("at") % ARITY).cast("int"))), "up")).drop("__tree", "__at", "digests")


def descend(nodes: DataFrame, heads: DataFrame, height: int) -> DataFrame:
    """(tree, at, digests, up, subroot, root) of the parents of leaves: ``up`` are the steps from each to the root of all.

    ``heads`` gives (tree, up, subroot, root) of the trees' own roots.
    """
    paths = None
    for level in range(max(height, 1), 0, -1):
        here = nodes.where(F.col("level") == level).select("tree", "at", F.col("digests").alias("own"), "head")
        made = here.where("head").join(heads, "tree")
        if paths is not None:
            made = made.unionByName(under(paths, here.where("not head")))
        paths = made.select("tree", "at", F.col("own").alias("digests"), "up", "subroot", "root")
    return paths


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "source", text: str = "text", fields: tuple = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``fields`` are hashed in their order. The leaves of a group ascend by id, a missing one first; rows of one id by
    digest, so that repeated rows, whose leaves are equal, may change places without a change to any digest. A missing
    group is one more, and the first. Null fields are told from empty ones. Rows without an id are not tampered with. An
    empty table gives an empty result; columns other than ``fields`` are not read, whatever their names.
    """
    value = lambda c: F.col(text).cast("string") if c == text else F.col(c)
    tampered = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    spoilt = [F.translate(value(c), UPPER, LOWER) if c == text else value(c) for c in fields]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(group).cast("string").alias("source"), leaf_digest(*map(value, fields)).alias("leaf"), F.when(tampered, leaf_digest(*spoilt)).alias("tampered"))
    rows, spans = ranges(rows, "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "leaves")
    spans = materialize(spans, "spans")
    groups, over = ranges(spans.select(F.col("group").alias("name")).distinct().withColumn("all", F.lit(0)), "all", [F.col("name").asc_nulls_first()], "groups")
    trees = placed(groups, over, "all").select("name", F.col("at").alias("tree"), F.col("size").alias("top"))
    spans = spans.join(trees, spans["group"].eqNullSafe(trees["name"])).drop("name")
    leaves = placed(rows, spans, "source").select("tree", "at", "size", "top", "doc_id", "source", "leaf", "tampered")
    leaves = materialize(leaves.sortWithinPartitions("tree", "at"), "leaves")
    drop(rows, groups)

    nodes = parents(leaves)
    heights = {r["over"]: r["h"] for r in nodes.groupBy((F.col("tree") == TOP).alias("over")).agg(F.max("level").alias("h")).collect()}
    no_steps = F.array().cast("array<struct<before:string,after:string>>").alias("up")
    subroots = nodes.where(f"head and tree <> {TOP}").select("tree", F.col("digest").alias("subroot")).unionAll(leaves.where("size = 1").select("tree", "leaf"))
    if True in heights:
        top = nodes.where(f"tree = {TOP}")
        head = top.where("head").select("tree", no_steps, F.lit("").alias("subroot"), F.col("digest").alias("root"))
        runs = descend(top, head, heights[True])
        tops = under(runs.drop("subroot").withColumn("subroot", F.lit("")), subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("subroot").alias("own")))
        tops = tops.select(F.col("at").alias("tree"), "up", F.col("own").alias("subroot"), "root")
    else:  # one group: its root is that of all
        tops = subroots.select("tree", no_steps, "subroot", F.col("subroot").alias("root"))
    tops = materialize(tops, "tops")
    runs = materialize(descend(nodes.where(f"tree <> {TOP}"), tops, heights.get(False, 0)), "runs")
    found = under(runs, leaves.where("size > 1")).unionByName(leaves.where("size = 1").join(tops, "tree"))
    folded = F.aggregate("up", F.coalesce("tampered", "leaf"), lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]).cast("binary"), 256))
    siblings = F.array_join(F.transform("up", lambda s: F.concat(s["before"], s["after"])), "")
    out = found.select("doc_id", "source", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
