import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, impact, root_sets


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 65536])
def test_packed_places(n):
    places = np.sort(np.random.default_rng(n).permutation(root_sets.PLACES)[:n])
    said = root_sets.packed(places)
    assert len(said) <= 8192 and np.array_equal(root_sets.unpacked(said), places)


@pytest.mark.parametrize("depth", [1, 3])
def test_equals_a_row_for_each_root_and_key(spark, depth):
    rng = random.Random(depth)
    pairs = [(f"k{rng.randrange(60)}", f"k{min(59, int(rng.expovariate(0.08)))}") for _ in range(150)]
    edges = spark.createDataFrame(pairs, "callee string, caller string")
    roots = spark.createDataFrame([(f"k{i}",) for i in range(70)], "key string")
    names = root_sets.numbered(roots)
    met = root_sets.reached(names, edges, depth)
    one = root_sets.gathered(met, met.select("key", F.concat_ws("|", "key", "depth").alias("owner")).distinct())
    got = {(r.key, r.depth, root) for r in met.collect() for root in r.slot * root_sets.PLACES + root_sets.unpacked(bytes(r.bits))}
    number = {r.root: r.key for r in names.collect()}
    assert {(number[int(root)], key, d) for key, d, root in got} == {tuple(r) for r in graph.reach(roots, edges, depth).select("root", "key", "depth").collect()}
    assert one.count() > 0


def brute(roots, edges, called, depth):
    out = {}
    for root in roots:
        seen, ahead = {root: 0}, [root]
        for k in range(1, depth + 1):
            ahead = {b for a in ahead for x, b in edges if x == a} - set(seen)
            seen |= dict.fromkeys(ahead, k)
        tests = {(p, line) for callee, p, line in called if seen.get(callee, depth) < depth}
        out[root] = (len(tests), any(d == depth and any(a == k for a, _ in edges) for k, d in seen.items()))
    return out


def test_covering_tests_of_all_members(spark):
    rng = random.Random(9)
    edges = [(f"k{rng.randrange(40)}", f"k{rng.randrange(40)}") for _ in range(60)]
    called = [(f"k{rng.randrange(40)}", f"T{rng.randrange(6)}.cs", rng.randrange(4)) for _ in range(30)]
    roots = [f"k{i}" for i in range(45)]
    rows = spark.createDataFrame([(c, p.upper() if i % 2 else p, line, True) for i, (c, p, line) in enumerate(called)] + [("k1", "no.cs", 1, False)], "callee string, path string, line int, is_test boolean")
    got = impact.covering(spark.createDataFrame([(r,) for r in roots], "key string"), spark.createDataFrame(edges, "callee string, caller string"), rows, 3)
    assert {r.key: (r.n_tests, r.bounded) for r in got.collect()} == brute(roots, edges, called, 3)


def test_more_roots_than_a_slot_has_places(spark):
    n = 70_000
    roots = spark.range(n).select(F.concat(F.lit("r"), "id").alias("key")).coalesce(1)
    edges = spark.range(n).select(F.concat(F.lit("r"), "id").alias("callee"), F.lit("hub").alias("caller"))
    names = root_sets.numbered(roots.coalesce(1))
    met = root_sets.reached(names, edges, 2)
    hub = met.where("key = 'hub'")
    assert hub.count() <= 8 * 2 and root_sets.counted(hub).agg(F.sum("n")).first()[0] == n
