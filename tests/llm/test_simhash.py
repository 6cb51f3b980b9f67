import numpy as np
import pytest
import xxhash

from tessera.llm import gray_index, simhash
from tessera.llm.components import components


def brute_print(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one Two", "ONE two THREE", "É é a b\x0bc  d\x1ce f", "a b c " * 700])
def test_fingerprint(text):
    assert simhash.majority(simhash.shingle_hashes(text, 3)) == brute_print(text)


def clusters(rng, centres, each, flips):
    out = set()
    for c in rng.integers(0, 1 << 63, size=centres, dtype=np.uint64):
        for _ in range(each):
            x = int(c) << 1 & (1 << 64) - 1
            for b in rng.integers(0, 64, size=rng.integers(0, flips + 1)):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_index_finds_all_pairs(radius):
    rng = np.random.default_rng(1)
    prints = np.array(clusters(rng, 12, 40, 4), dtype=np.uint64)
    group = np.sort(rng.integers(0, 3, size=len(prints)))
    order = np.lexsort((gray_index.gray_rank(prints), group))
    p, g = prints[order], group[order]
    got = {(int(i), int(j)) for a, b in gray_index.Index(p.reshape(-1, 1), g).within(radius) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if g[i] == g[j] and bin(int(p[i]) ^ int(p[j])).count("1") <= radius}
    assert got == want


@pytest.mark.parametrize("most", [4096, 12])
def test_groups(spark, most):
    prints = clusters(np.random.default_rng(2), 25, 30, 3)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)] + [(None, 0), (5000, 0), (5001, 1)]
    got = simhash.grouped(spark.createDataFrame(rows, "doc_id long, print long"), most=most).collect()
    want = brute_groups([*prints, 0, 0, 1], 2)
    ids = [*range(len(prints)), None, 5000, 5001]
    low = {}
    for i, w in zip(ids, want):
        if i is not None:
            low[w] = min(low.get(w, i), i)
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted((str(i), low[w]) for i, w in zip(ids, want))


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.a: r.b for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100}


def test_query(spark, tmp_path):
    texts = ["a b c d e f g", "A b c d e f g", None, "", "x", "q " * 500, "other words here"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id long, text string, component_id long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(spark, str(tmp_path)).collect())
    assert [g[1] for g in got[1:]] == [f"{brute_print(t):016x}" for t in texts]
    assert [g[2] for g in got] == [0, 0, 0, 2, 2, 4, 5, 6]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert simhash.query(spark, str(tmp_path)).count() == 0
