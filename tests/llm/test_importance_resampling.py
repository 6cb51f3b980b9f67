import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import importance_resampling as ir


def features(text, runs):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, runs=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x, runs)[1]) for rows in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in docs:
        w, f = features(text, runs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for rank, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[5] = rank
    return sorted((tuple(x) for x in out), key=str)


DOCS = [(i, " ".join(f"w{(i * j) % 97} Große-Wörter{j % 7}" for j in range(i % 60))) for i in range(300)]
DOCS += [(None, "null id " * 20), (7, None), (8, ""), (9, "...---"), (10, "one's two_three 4You ÄÖ"), (12, "x y " * 20000)]
TARGET = [(1, "w1 w2 w3 große wörter1 x"), (2, None), (3, "Y y y W5")]


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("runs", [1, 3])
def test_equals_brute_force(spark, runs):
    docs, target = (spark.createDataFrame(x, "doc_id long, text string").repartition(4) for x in (DOCS, TARGET))
    assert got(ir.resampled(docs, target, ir.Draw(runs=runs))) == brute(DOCS, TARGET, runs)


def test_totals_of_a_trie():
    trie = ir.Trie(2, 1000)
    for text in ("a b c", "a b a b"):
        trie.add(trie.walk(ir.words(text)))
    want = Counter(zlib.crc32(f.encode()) % 1000 for text in ("a b c", "a b a b") for f in features(text, 2)[1])
    assert {i: n for i, n in enumerate(trie.totals()) if n} == dict(want)


def test_ties_and_repeated_rows(spark):
    rows = [(1, "same words here " * 10)] * 40 + [(2, "other words " * 12)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, rank int, score int")
    found = ir.resampled(docs, docs.limit(0), ir.Draw(percent=50)).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21))
    assert sorted(map(str, {(r.doc_id, r.weight, r.score) for r in found})) == sorted(map(str, {(x[0], x[3], x[4]) for x in brute(rows, [])}))


def test_empty(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert ir.query(spark, str(tmp_path)).count() == 0
