import random

import pytest

import corpus_pipeline
from tessera.llm import near_duplicates as n


def words(rng, k):
    return [rng.choice("aeiou") + "".join(rng.choice("bcdfghjklm") for _ in range(6)) for _ in range(k)]


def jaccard(a, b):
    sh = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y)


def corpus(rng):
    rows = []
    for i in range(60):
        w = words(rng, rng.choice([9, 40, 200, 900]))
        rows.append((100 * i, w))
        for k in range(rng.randrange(3)):
            v = list(w)
            for _ in range(len(w) // 100):
                v[rng.randrange(len(v))] = words(rng, 1)[0]
            rows.append((100 * i + k + 1, v))
    return rows


@pytest.mark.parametrize("most", [4096, 3])
def test_groups(spark, most):
    rows = corpus(random.Random(1))
    rng = random.Random(2)
    base = words(rng, 300)
    for k in range(40):  # one large group of near copies
        v = list(base)
        v[rng.randrange(300)] = "zz"
        rows.append((10_000 + k, v))
    docs = spark.createDataFrame([(i, " ".join(w), i) for i, w in rows], "row long, text string, root long")
    got = {r.row: r.root for r in n.grouped(docs, most).collect()}
    for a, x in rows:
        for b, y in rows:
            if a < b:
                j = jaccard(x, y)
                if j >= 0.8:
                    assert got[a] == got[b], (a, b, j)
                elif j < 0.3:
                    assert got[a] != got[b], (a, b, j)


def test_kept(spark):
    rows = [(1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None), (4, ""), (5, "other"), (5, "other"), (None, "alone")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, root string, node int")
    out = n.kept(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "a b c"), ("3", None), ("5", "other"), ("None", "alone")]
    assert n.kept(docs.where("false")).count() == 0


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(7)
    prose = lambda k: " ".join(x + (" the" if i % 4 == 0 else "") for i, x in enumerate(words(rng, k)))
    item = " ".join(words(rng, 30))
    rows = [(i, prose(150), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(10)]
    rows += [(200, prose(80) + " " + item + " " + prose(80), "en", "s1"), (201, "too short", "en", "s1"), (202, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        left.append({r.doc_id for r in now.collect()})
    assert left[0] == {r[0] for r in rows} - {201, 202}
    assert left[1] == left[0] - set(range(100, 110))
    assert left[2] == left[1] - {200}
    mixed = corpus_pipeline.STAGES[3][1](spark, now, str(tmp_path))
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= left[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == mixed.count()
    ends = sorted((r.start, r.start + r.n_tokens) for r in out)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_all_classes_of_a_large_route_meet(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):  # unrelated pairs of one bit's difference, all on one route
        f = [rng.getrandbits(63) for _ in range(n.WORDS)]
        rows += [(2 * k, *f, [7]), (2 * k + 1, f[0] ^ 1, *f[1:], [7])]
    classes = spark.createDataFrame(rows, f"node long, {', '.join(f'f{i} long' for i in range(n.WORDS))}, routes array<long>")
    got = {tuple(sorted((r.a, r.b))) for r in n.links(classes, 8).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(300)}


def test_links_are_by_similarity(spark):
    rng = random.Random(9)
    rows = []
    for k in range(250):  # pairs from 0.7 to 0.88, each alone
        w = words(rng, rng.choice([60, 150, 400]))
        v = list(w)
        for at in rng.sample(range(len(v) // 6), round(len(v) / 6 * rng.uniform(0.09, 0.19))):
            v[6 * at + 2] = words(rng, 1)[0]
        rows += [(2 * k, w), (2 * k + 1, v)]
    got = {r.row: r.root for r in n.grouped(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "row long, text string")).collect()}
    pairs = [(jaccard(rows[i][1], rows[i + 1][1]), got[i] == got[i + 1]) for i in range(0, len(rows), 2)]
    assert min(sum(j >= 0.8 for j, _ in pairs), sum(j < 0.8 for j, _ in pairs)) > 50
    assert [same for _, same in pairs] == [j >= 0.8 for j, _ in pairs]
