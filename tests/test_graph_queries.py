from collections import Counter, defaultdict

import pytest

from tessera.plans import registry

#: (callee, caller): a chain of eight nations with a cycle at its start, apart from a pair
EDGES = [(k, k + 1) for k in range(7)] + [(1, 0), (20, 21), (20, 21), (20, 20)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("calls"))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    nations = range(25)
    save([(k, 1 if k in (0, 20) else 0) for k in nations], "n_nationkey int, n_regionkey int", "nation")
    save([(k, k) for k in nations], "c_custkey long, c_nationkey int", "customer")
    save([(k, k) for k in nations], "s_suppkey long, s_nationkey int", "supplier")
    save([(i, b) for i, (_, b) in enumerate(EDGES)], "o_orderkey long, o_custkey long", "orders")
    lines = [(i, a, "RAN"[i % 3], 0.01 * (i % 11), 1.0 + i) for i, (a, _) in enumerate(EDGES)]
    save(lines, "l_orderkey long, l_suppkey long, l_returnflag string, l_discount double, l_quantity double", "lineitem")
    return path


def rows(spark, name, tables):
    return {tuple(r) for r in registry.QUERIES[name](spark, tables).collect()}


def within(root, steps, depth):
    seen, ahead = {root: 0}, [root]
    for k in range(1, depth + 1):
        ahead = [b for b in {b for a in ahead for b in steps[a]} if b not in seen]
        seen |= dict.fromkeys(ahead, k)
    return seen


def test_every_line_item_is_an_edge(spark, tables):
    calls, callers, steps = Counter(a for a, _ in EDGES), defaultdict(set), defaultdict(set)
    for a, b in EDGES:
        callers[a].add(b)
        steps[a].add(b)
    assert rows(spark, "graph_fan_in", tables) == {(a, n, len(callers[a])) for a, n in calls.items()}
    top = set()
    for a in calls:
        by = sorted(Counter(b for x, b in EDGES if x == a).items(), key=lambda x: (-x[1], x[0]))
        top |= {(a, b, n, i) for i, (b, n) in enumerate(by[:3], 1)}
    assert rows(spark, "graph_callers_topk", tables) == top
    assert rows(spark, "graph_reach", tables) == {(root, k, d) for root in (0, 20) for k, d in within(root, steps, 6).items()}
    far = {a: within(a, steps, 25) for a in range(25)}
    groups = {a: {b for b in far[a] if a in far[b]} for a in range(25)}
    assert rows(spark, "graph_scc", tables) == {(a, min(g), len(g)) for a, g in groups.items() if len(g) > 1}
