"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as keep the same nodes connected: the members of each component, chained in order."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        apart = lu != lv
        if not apart.any():
            break
        lu, lv = lu[apart], lv[apart]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    return nodes[order[:-1]][same], nodes[order[1:]][same]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is one node of its component.

    Each round every node moves to that of its neighbours (or itself) with the smallest hash, edges are rewritten
    between the places moved to, and repeated edges and loops go. The hash changes with the round, so that a chain
    shrinks by a constant factor whatever its numbering. Nodes without edges to others don't appear. Null ends are
    dropped. All state is in tables in the shared folder.
    """
    tidy = lambda d: d.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(tidy(edges), "edges")
    moved = None
    turn = 0
    while not edges.isEmpty():
        rank = lambda c, turn=turn: F.xxhash64(c, F.lit(turn))
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), "b")).alias("m"))
        step = best.select(F.col("a").alias("node"), F.when(F.col("m.h") < rank("a"), F.col("m.b")).otherwise(F.col("a")).alias("root"))
        step = materialize(step, "step")
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = materialize(tidy(edges.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
        if moved is None:
            moved = step
        else:
            nxt = step.select(F.col("node").alias("root"), F.col("root").alias("after"))
            moved = materialize(moved.join(nxt, "root", "left").select("node", F.coalesce("after", "root").alias("root")), "moved")
        turn += 1
    if moved is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return moved
