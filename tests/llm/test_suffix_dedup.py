import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as s


def brute(texts, keep_first=False, length=s.LENGTH):
    """Removed flags by the contract's own wording."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raws):
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((i, k))
    gone = [np.zeros(len(b), dtype=bool) for b in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places[1:] if keep_first else places:
                gone[i][k : k + length] = True
    return raws, gone


def test_longest_previous_factors():
    rng = random.Random(1)
    for _ in range(40):
        b = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40)))
        want = [max([0, *(next((m for m in range(len(b) - i) if b[j + m] != b[i + m]), len(b) - i) for j in range(i))]) for i in range(len(b))]
        assert s.longest_previous_factors(b).tolist() == want


def test_anchors_are_the_same_for_equal_strings():
    rng = random.Random(2)
    b = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    c = b"x" * 300 + b[500:2300] + b"y" * 50
    seen = {}
    for text in (b, c):
        for (anchor, _, first, n, short), stretches in s.anchors(text):
            assert n.sum() == len(text) - s.LEAST + 1 and not stretches
            assert short[-1] == s.LENGTH - s.LEAST
            for h, f, m in zip(anchor, first, n):
                for k in range(f, f + m):
                    w = text[k : k + s.LEAST]
                    assert seen.setdefault(w, h) == h


def test_periods_give_few_records():
    for text in (b"a" * 300_000, b"ab" * 200_000, b"xyz%" * 9 + b"0123456789" * 50_000 + b"end" * 100):
        (records, stretches), *more = s.anchors(text)
        assert len(records[0]) < 1000 and stretches, text[:4]


def corpus(seed=3):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdefghij éü\n") for _ in range(n))
    passage, other = prose(520), prose(900)
    texts = [prose(rng.randrange(900)) + passage + prose(rng.randrange(900)) for _ in range(30)]
    texts += [prose(300) + other[: rng.randrange(350, 900)] + prose(40) for _ in range(12)]
    texts += [None, "", "short", "a" * 1500, "ab" * 700, prose(450) * 3, passage[:399], passage[:390] + "q" + passage[391:]]
    texts += ["a" * 399, "x" + "a" * 401 + "y", "ab" * 200, "b" + "a" * 640 + prose(90), prose(7) * 120, other[:300] + prose(9)]
    near = prose(2500)
    for _ in range(8):
        v = list(near)
        v[rng.randrange(len(v))] = "#"
        texts.append("".join(v))
    return texts + [near, near]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("most", [512, 3])
def test_against_brute_force(spark, keep_first, most):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = s.keyed(docs)
    got = {r.doc_id: r for r in s.cut_out(rows, s.removals(rows, keep_first, most)).collect()}
    raws, gone = brute(texts, keep_first)
    _, told = brute(texts, keep_first, s.LEAST)
    for i, (b, g) in enumerate(zip(raws, gone)):
        for ranges, want in ((got[i].spans, g), (got[i].passages, told[i])):
            flags = np.zeros(len(b), dtype=bool)
            for x, y in ranges:
                flags[x:y] = True
            assert (flags == want).all(), (i, len(b))
        assert bytes(got[i].kept) == bytes(np.frombuffer(b, dtype=np.uint8)[~g])


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(s, "PART", 1 << 10)  # long texts in parts
    texts = corpus(4)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, texts[1], 1)]
    spark.createDataFrame(rows, "doc_id long, text string, key long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r)[:5] for r in s.query(spark, str(tmp_path)).collect()), key=str)
    raws, gone = brute([r[1] for r in rows])
    want = []
    for (i, _, _), b, g in zip(rows, raws, gone):
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~g])
        want.append((i, len(b), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert s.query(spark, str(tmp_path)).count() == 0
