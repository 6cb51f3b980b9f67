import math

import numpy as np
import pytest

from tessera.llm import hard_negatives as hn
from tessera.llm.ball_tree import Best, Tree

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def brute(rows):
    held = []
    for vec_id, x, label, *_ in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        held.append((vec_id, label, [math.floor(256 * float(np.float32(v))) for v in x]))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, label, v) in enumerate(held):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), last(i), i, m) for b, (i, m, w) in enumerate(held) if b != a]
        for s, _, positive, _ in sorted(x for x in scored if x[3] == label)[:5]:
            fit = sorted((t, k, i) for t, k, i, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out += [(anchor, positive, n, i, -s, -t) for n, (t, _, i) in enumerate(fit, 1)]
    return sorted(out, key=str)


def vectors(n, seed, dims=6, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dims))
    label = rng.integers(0, labels, size=n)
    x = (centre[label] + rng.normal(size=(n, dims)) * 0.8).astype(np.float32)
    return [(i, x[i].tolist(), int(label[i]), 0) for i in range(n)]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 3)
    rows = vectors(900, 1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(hn.mined(docs)) == brute(rows)


def test_cases(spark, tmp_path):
    rows = vectors(230, 2, labels=3)
    x = rows[5][1]
    rows += [(None, x, 1, 0), (None, x, 0, 0), (300, None, 1, 0), (301, x, None, 0), (302, [math.nan] * 6, 1, 0), (303, [math.inf] * 6, 1, 0), (304, [None] * 6, 1, 0)]
    rows += [(100, rows[100][1], rows[100][2], 0), (50, rows[50][1], 9, 0), (305, x[:3], 2, 0), (306, [], 2, 0), (400, [0.0] * 6, 7, 0)]
    rows += [(310 + i, x, 2, 0) for i in range(30)]  # ties
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert got(hn.query(spark, str(tmp_path))) == brute(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert hn.query(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_search_over_chunks(same):
    rng = np.random.default_rng(3)
    n, a = 3000, 40
    x, label = rng.integers(-50, 50, size=(n, 8)), rng.integers(0, 3, size=n)
    q, q_label = x[:a], label[:a]
    low = np.stack([np.full(a, -2000), np.full(a, 500)], axis=1)
    high = np.stack([np.full(a, 1500), np.full(a, 9000)], axis=1)
    best = Best(q, q_label, np.arange(a), same, low, high, 7)
    for at in range(0, n, 700):
        best.look(x[at : at + 700], label[at : at + 700], np.arange(at, min(n, at + 700)), np.arange(at, min(n, at + 700)))
    for w in range(2):
        want = []
        for i in range(a):
            s = x @ q[i]
            fit = [(-s[j], j) for j in range(n) if (label[j] == q_label[i]) == same and j != i and low[i, w] <= s[j] <= high[i, w]]
            want += [(i, -t, j, j) for t, j in sorted(fit)[:7]]
        assert sorted(map(tuple, best.found[w].tolist())) == sorted(want)


def test_nodes_outside_the_window_are_left_out():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(500, 8)) * 3 + c for c in (0, 100, 200, 300)]).round()
    tree = Tree(x, np.zeros(len(x), dtype=np.int64))
    q = np.ones((1, 8))
    seen = [np.arange(lo, hi) for lo, hi, _ in tree.leaves(q, np.array([1]), False, np.array([[700.0]]), np.array([[900.0]]))]
    assert 0 < sum(map(len, seen)) < 900
    inside = np.flatnonzero((tree.x @ q[0] >= 700) & (tree.x @ q[0] <= 900))
    assert set(inside) <= set(np.concatenate(seen))
