import random

import numpy as np
import pytest

from tessera.llm import decontaminate as d


def distance_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(rng, t, n):
    t = list(t)
    for _ in range(n):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        t[i : i + 1] = [] if kind == 0 else [rng.choice("klm")] if kind == 1 else [t[i], rng.choice("klm")]
    return "".join(t)


def test_alignment():
    rng = random.Random(3)
    for _ in range(60):
        p = words(rng, 4).encode()
        t = (words(rng, 2) + edited(rng, p.decode(), rng.randrange(6)) + words(rng, 2)).encode()
        want = distance_inside(p, t)
        assert d.edits_inside([p], [t], 8).tolist() == [min(want, 9)]


def test_alignments_together():
    rng = random.Random(5)
    p = [bytes(rng.choice(b"klmno ") for _ in range(40)) for _ in range(50)]
    t = [(words(rng, 2) + edited(rng, x.decode(), rng.randrange(14)) + words(rng, rng.randrange(3))).encode() for x in p]
    assert d.edits_inside(p, t, 8).tolist() == [min(distance_inside(x, y), 9) for x, y in zip(p, t)]


def frequent(rng, size):
    vocabulary = ["".join(rng.choice("etaoin") for _ in range(rng.randint(2, 6))) for _ in range(2000)]
    return " ".join(rng.choices(vocabulary, [1 / k for k in range(1, 2001)], k=size // 4))[:size]


def test_a_long_text_of_frequent_words_stays_small(monkeypatch):
    rng = random.Random(6)
    text = frequent(rng, 300_000)
    w = d.Windows([(i, text[i : i + 500]) for i in range(0, len(text), 500)])
    mixed = text.split(" ")
    rng.shuffle(mixed)
    clean = " ".join(mixed)[:30_000]
    sizes = []
    monkeypatch.setattr(d.Windows, "_piece", lambda self, at, k, low, high, f=d.Windows._piece: sizes.append(int(self.n[k].sum()) if high - low == self.size else 0) or f(self, at, k, low, high))
    assert w.find([d.plain(clean)]) == []
    assert len(sizes) > 3 and max(sizes) < 2 * d.POSTS
    # what lies across the cuts is found all the same
    held = " ".join(mixed)[:6_000] + " " + text[7_000:7_200] + " " + " ".join(mixed)[6_000:12_000]
    monkeypatch.setattr(d, "POSTS", 50_000)
    assert 0 in {x[2] for x in w.find([d.plain(held)])}


def test_many_equal_hits_are_cut_by_places():
    w = d.Windows([(1, "a" * 4000), (2, "b c " * 300)])
    assert {w.item[k] for _, k, _ in w.find([b"x " + b"a" * 300 + b" y"])} == {1}


def test_finds_what_brute_force_finds():
    rng = random.Random(4)
    items = [(i, words(rng, n)) for i, n in enumerate([3, 8, 20, 30, 60, 90, 1])]
    w = d.Windows(items)
    texts = []
    for _ in range(150):
        i, t = rng.choice(items)
        texts.append(d.plain(words(rng, rng.randrange(40)) + " " + edited(rng, t, rng.randrange(0, 14)) + " " + words(rng, rng.randrange(40))))
    got = {(i, int(k)): e for i, k, e in w.find(texts)}
    for i, t in enumerate(texts):
        for k, p in enumerate(w.text):
            if len(p) >= d.Q:
                e = distance_inside(p, t)
                assert ((i, k) in got) == (e <= w.edits[k])
                assert got.get((i, k), e) == e


def test_windows_cover_items():
    rng = random.Random(5)
    for n in (1, 17, 20, 40, 41, 200):
        t = d.plain(words(rng, n))
        w = d.Windows([(1, t.decode())])
        assert all(len(x) <= d.WINDOW + d.STEP for x in w.text)
        covered = np.zeros(len(t), dtype=bool)
        for x in w.text:
            at = t.find(x)
            covered[at : at + len(x)] = True
        assert covered.all()


@pytest.fixture()
def tables(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a potion of strength for the king"
    rows = [(0, "x " * 9 + item.upper() + " y"), (1, item[:-40]), (2, None), (3, ""), (4, item.replace("fox", "fax").replace(" ", ",  ")), (4, item.replace("fox", "fax").replace(" ", ",  ")), (5, "clean " * 40), (None, item), (6, "long " * 30000 + item)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, str(tmp_path)


def test_query(spark, tables):
    docs, path = tables
    got = sorted((str(r.doc_id), r.n_items, list(r.items)) for r in d.query(spark, path).collect())
    assert got == [(i, 1, [7]) for i in ("0", "4", "4", "6", "None")]
    kept = d.stage(spark, docs, path)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5]


def test_blocks_and_empty(spark, tables, monkeypatch):
    docs, path = tables
    monkeypatch.setattr(d, "BLOCK", 50)
    assert d.query(spark, path).count() == 5
    rows = docs.selectExpr("doc_id as row", "text")
    assert d.found(rows, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert d.found(rows.where("false"), spark.read.parquet(f"{path}/benchmark.parquet")).count() == 0


def test_passages_of_items():
    rng = random.Random(6)
    for n in (120, 150, 233, 400):
        item = d.plain(words(rng, 120))[:n].decode()
        w = d.Windows([(1, item)])
        least = d.WINDOW + d.STEP - 1
        texts = [d.plain(words(rng, 30) + " " + item[at : at + least] + " " + words(rng, 30)) for at in range(n - least + 1)]
        assert {i for i, _, _ in w.find(texts)} == set(range(len(texts)))
        assert not w.find([d.plain(words(rng, 200))])


def test_address_of_no_window():
    w = d.Windows([(1, "a passage of the benchmark that is nowhere else")])
    w.seen[:] = True
    assert w.find([b"other words that share an address with it"]) == []
