import random

import pytest

from netloom.operators import geometry, graphs, within


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def random_modules(seed):
    rng = random.Random(seed)
    nodes = [(m, f"n{k}") for m in range(12) for k in range(rng.randint(1, 8))]
    edges = [(m, f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}") for m in range(13) for _ in range(rng.randint(0, 12))]
    return nodes, edges


def reach(edges, module, start, known=None):
    """{node: depth} by rounds over all edges, to ``known`` nodes if given."""
    depth, k = {start: 0}, 0
    while True:
        k += 1
        new = {b for m, a, b in edges if m == module and depth.get(a) == k - 1 and b not in depth and (known is None or (m, b) in known)}
        if not new:
            return depth
        depth |= dict.fromkeys(new, k)


def brute(nodes, edges):
    known = set(nodes)
    inner = [(m, a, b) for m, a, b in edges if (m, a) in known and (m, b) in known and a != b]
    to = {(m, n): set(reach(inner, m, n)) for m, n in known}
    comp = {(m, n): max(x for x in to[m, n] if n in to[m, x]) for m, n in known}

    def level(m, c):  # longest path over components
        return max((1 + level(m, comp[m, a]) for k, a, b in inner if k == m and comp[m, b] == c and comp[m, a] != c), default=0)

    return sorted((m, n, comp[m, n]) for m, n in known), sorted((m, n, level(m, comp[m, n])) for m, n in known)


@pytest.mark.parametrize("most", [within.LARGE, 0, 9])
def test_components_and_layers(spark, most):
    nodes, edges = random_modules(most)
    n, e = spark.createDataFrame([*nodes, *nodes[:5], (None, "x")], "module int, node string"), spark.createDataFrame([*edges, *edges[:5], (None, "x", "x")], "module int, src string, dst string")
    components, layers = brute(nodes, edges)
    assert rows(within.components(n, e, most), "module", "node", "component") == components
    assert rows(within.layers(n, e, most), "module", "node", "level") == layers


@pytest.mark.parametrize("most", [0, 9])
def test_levels_by_function_and_by_rounds(spark, most):
    nodes, edges = random_modules(most + 100)
    n, e = spark.createDataFrame(nodes, "module int, node string"), spark.createDataFrame(edges, "module int, src string, dst string")
    for f, columns in ((within.partial_levels, ["module", "node", "level", "resolved"]), (within.settled_levels, ["module", "node", "level"])):
        assert rows(f(n, e, most), *columns) == rows(f(n, e), *columns)


@pytest.mark.parametrize("most", [within.MOST_STEPS, 0, 12])
def test_reach(spark, most):
    nodes, edges = random_modules(most + 7)
    starts = [x for x in nodes if x[1] in ("n0", "n2")] + [(77, "alone")]
    found = within.reachable(spark.createDataFrame(edges, "module int, src string, dst string"), spark.createDataFrame(starts, "module int, node string"), most)
    assert rows(found, "module", "start", "node", "depth") == sorted((m, s, n, k) for m, s in starts for n, k in reach(edges, m, s).items())


def test_empty_graphs(spark):
    n, e = spark.createDataFrame([], "module int, node string"), spark.createDataFrame([], "module int, src string, dst string")
    for found in (within.components(n, e), within.layers(n, e), within.partial_levels(n, e), within.settled_levels(n, e), within.reachable(e, n)):
        assert found.isEmpty()


def test_a_long_chain_needs_no_recursion(spark):
    n = spark.range(5000).selectExpr("1 AS module", "id AS node")
    e = spark.range(4999).selectExpr("1 AS module", "id AS src", "id + 1 AS dst")
    assert within.layers(n, e).agg({"level": "max"}).first()[0] == 4999
    assert within.components(n, e).where("node = component").count() == 5000


def test_instances_keep_their_order_in_ties(spark):
    nodes = spark.createDataFrame([(1, "p", 0, "b"), (1, "q", 0, "B"), (1, "r", 0, None), (1, "s", 1, "x"), (1, "t", 1, "a")], "module int, node string, level int, label string")
    edges = spark.createDataFrame([(1, "q", "s"), (1, "p", "t"), (1, "p", "s"), (1, "q", "t"), (2, "p", "q")], "module int, src string, dst string")
    # r has no label, B comes before b; both of the second level are at the mean of q and p and stay as they were
    assert rows(geometry.instance_order(nodes, edges), "level", "place", "node") == [(0, 0, "q"), (0, 1, "p"), (0, 2, "r"), (1, 0, "t"), (1, 1, "s")]
