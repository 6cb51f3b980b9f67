import random

import numpy as np
import pytest

from tessera.llm import parity_join as pj
from tessera.llm.common import written


def brute_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k=5):
    sets = [brute_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def texts(seed, n, words=400):
    """Groups of copies at all distances around the limit, with passages that many texts share."""
    rng = random.Random(seed)
    common = [" ".join(f"c{rng.randrange(50)}" for _ in range(40)) for _ in range(3)]
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(words)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20, 30, 60, 150, 400]))]
        if rng.random() < 0.5:
            base += rng.choice(common).split()
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            x = list(base)
            for _ in range(rng.randrange(0, 2 + len(x) // 25)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.choice([0, 1])] = [f"e{rng.randrange(1000)}"] * rng.choice([0, 1, 1])
            if rng.random() < 0.2:
                x += [f"t{rng.randrange(1000)}" for _ in range(rng.randrange(1 + len(x) // 4))]
            out.append(" ".join(x) if rng.random() < 0.9 else " ".join(x).upper())
    return out[:n]


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [4096, 6])
def test_equals_brute_force(spark, most):
    rows = list(enumerate(texts(7, 700)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(pj.joined(docs, most=most)) == brute(rows)


def test_one_large_group_in_blocks(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):  # a chain: neighbours link, the ends don't
        x = list(base)
        for j in range(i):
            x[3 * j] = f"x{j}"
        rows.append((i, " ".join(x)))
    rows += [(100 + i, " ".join(base[: 195 + i % 5]) + f" {rng.random()}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(pj.joined(docs, most=8)) == brute(rows)


def test_bands_and_parts():
    starts = pj.band_starts()
    assert np.all(np.diff(starts) > 0)
    for a in [*range(1, 300), 1000, 12345]:
        for b in {a, a + 1, a * 5 // 4} - {0}:
            if a <= b <= a * 5 // 4:
                band = int(np.searchsorted(starts, a, side="right")) - 1
                assert band in pj.bands_of(a) and band in pj.bands_of(b)
                assert pj.budget(a, b) <= pj.parts_of(band)[0]


def test_pairs_within_the_budget_share_a_signature():
    rng = np.random.default_rng(5)
    for n in [4, 5, 6, 8, 11, 17, 40, 90, 300]:
        for _ in range(150):
            a = np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2))
            out = rng.integers(0, n // 5 + 1)
            inn = rng.integers(0, n // 5 + 1)
            b = np.unique(np.r_[rng.permutation(a)[out:], rng.integers(0, 1 << 63, size=inn, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            d = len(a) + len(b) - 2 * both
            assert pj.distance(pj.sketch(a), pj.sketch(b)) <= d
            if 100 * both >= 80 * (len(a) + len(b) - both) and d:
                assert len(np.intersect1d(pj.signatures(a), pj.signatures(b)))


def test_shared_signatures(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(400), rng.randrange(5)) for _ in range(900)]
    want = {r for r in rows if len({n for s, n in rows if s == r[0]}) > 1}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = [(r.sig, r.node) for r in pj.shared(spark.createDataFrame(rows, "sig long, node long")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(out) == sorted(want)


def test_frequent_signatures_are_left_only_by_sets_that_can_spare_them(spark):
    sig = 5 << 56
    members = spark.createDataFrame([(sig, n) for n in range(4)] + [(sig + 1, 0), (sig + 1, 9)], "sig long, node long")
    classes = spark.createDataFrame([(0, [4, 5], [9, 1]), (1, [5], [0]), (2, [5], [-1]), (3, [5, 6], [2, 0]), (9, [5], [0])], "node long, bands array<int>, spare array<int>")
    out = pj.without_spared(written(members), written(classes), 3)
    assert sorted((r.sig - sig, r.node) for r in out.collect()) == [(0, 1), (0, 2), (1, 0), (1, 9)]


def test_query_and_cases(spark, tmp_path):
    long = " ".join(f"w{i % 900}" for i in range(30000))
    rows = [(1, "a b c d e f g"), (2, "A  b c D e\tf g"), (3, None), (4, ""), (5, "x"), (6, "X"), (7, long), (8, long + " end"), (None, "x"), (1, "a b c d e f g"), (None, "only here"), (9, " \n")]
    spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, node int, component_id int").write.parquet(str(tmp_path / "documents.parquet"))
    assert got(pj.query(spark, str(tmp_path))) == brute(rows, 5)[:0] + sorted([*brute([r for r in rows if brute_set(r[1])]), (3, 0, 3), (4, 0, 4), (9, 0, 9)], key=str)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert pj.query(spark, str(tmp_path)).count() == 0
