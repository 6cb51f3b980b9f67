import random

import pytest

from tessera.operators import graph


def brute(edges):
    """(node, smallest of its component, size) of nodes on cycles of two or more, by closure."""
    nodes = {x for e in edges for x in e}
    reach = {a: {b for x, b in edges if x == a} for a in nodes}
    for k in nodes:
        for a in nodes:
            if k in reach[a]:
                reach[a] |= reach[k]
    group = {a: {b for b in nodes if a == b or b in reach[a] and a in reach[b]} for a in nodes}
    return {(a, min(g), len(g)) for a, g in group.items() if len(g) > 1}


def got(spark, edges):
    # an edge goes from caller to callee
    return {tuple(x) for x in graph.cycles(spark.createDataFrame([(b, a) for a, b in edges], "callee long, caller long")).collect()}


def ring(nodes):
    return list(zip(nodes, [*nodes[1:], nodes[0]]))


SHAPES = {
    "path": [(i, i + 1) for i in range(20)],
    "ring": ring(list(range(5, 30))),
    "ring with tails": ring([9, 4, 7, 1]) + [(20, 9), (21, 20), (22, 21), (7, 30), (30, 31)],
    "rings on a rope": ring([1, 2, 3]) + [(3, 10), (10, 11), (11, 12)] + ring([12, 13, 14]) + [(14, 2 * 10), (20, 21)],
    "two rings that share a node": ring([1, 2, 3, 4]) + ring([1, 12, 13, 14, 15]),
    "eight with long sides": ring([1, *range(10, 40)]) + ring([1, *range(50, 70)]) + [(70, 55), (71, 70)],
    "pair and loops": [(1, 2), (2, 1), (3, 3), (4, 5)],
    "clique": [(a, b) for a in range(6) for b in range(6) if a != b] + [(5, 9), (9, 10), (10, 2), (2, 11), (11, 12)],
    "tree": [((i - 1) // 2, i) for i in range(1, 31)],
    "nothing": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    assert got(spark, SHAPES[shape]) == brute(SHAPES[shape])


@pytest.mark.parametrize("seed,n,m", [(1, 30, 40), (2, 40, 46), (3, 25, 60)])
def test_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    assert got(spark, edges) == brute(edges)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "saved", lambda df, f=graph.saved: written.append(1) or f(df))
    counts = {}
    for shape in ("path", "ring"):
        for n in (16, 256):
            written.clear()
            nodes = list(range(n))
            random.Random(n).shuffle(nodes)
            edges = ring(nodes) if shape == "ring" else list(zip(nodes, nodes[1:]))
            assert len(got(spark, edges)) == (n if shape == "ring" else 0)
            counts[shape, n] = len(written)
    # sixteen times the nodes are four more doublings
    assert all(counts[s, 256] <= counts[s, 16] + 5 for s in ("path", "ring"))
