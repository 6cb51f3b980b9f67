import random

import numpy as np
import pytest

from tessera.llm import co_training as c


def corpus(n=700):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 8)))
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [word() + (rng.choice(["%%%", "###"]) if bad else "") for _ in range(rng.randint(20, 80))]
        t = " ".join(w).upper() if bad else " ".join(w)
        docs.append((i, t, f"s{int(bad) * 5 + rng.randrange(4)}", "en", len(t), 0.0))
        if i % 3 != 2:
            labels.append((i, int(not bad), 0))
    return docs, labels


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, score double"


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus()
    more = [(5000, None, None, None, None, 0.0), (5001, "", "s", "en", -1, 0.0), (None, "x y", "s1", "en", 3, 0.0), (4, *docs[4][1:]), (5002, "abc def " * 40000, "s2", "en", 1, 0.0)]
    spark.createDataFrame(docs + more, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = c.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + len(more)
    truth = {i: i % 4 != 0 for i in range(len(docs))}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    for score in ("score", "text_score", "page_score"):
        assert sum((r[score] >= 0.5) == truth[r.doc_id] for r in held) >= 0.95 * len(held), score
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    same = [r.score for r in got if r.doc_id == 4]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])


def test_files_decide_nothing(spark):
    docs, labels = corpus(400)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, SCHEMA)
    one, many = ({r.doc_id: r for r in c.classified(f, y).collect()} for f in (frame.coalesce(1), frame.repartition(7)))
    for score in ("score", "text_score", "page_score"):
        assert max(abs(one[i][score] - many[i][score]) for i in one) < 1e-3, score


def test_the_page_view_beats_the_larger_share(spark):
    """Where only the layout of a source tells, and not by more or less of anything."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        source, lines = rng.randrange(3), rng.choice([1, 8, 60])
        docs.append((i, "\n".join("x" * rng.randint(20, 40) for _ in range(lines)), f"s{source}", "en", None, 0.0))
        labels.append((i, int((lines == 8) == (source > 0)), 0))
    got = c.classified(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    truth = {i: q for i, q, _ in labels}
    share = sum(truth[r.doc_id] for r in got) / len(got)
    assert sum((r.page_score >= 0.5) == truth[r.doc_id] for r in got) / len(got) >= max(share, 1 - share) + 0.15


def test_lbfgs():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(12, 12))
    m = m @ m.T + np.eye(12)
    want = rng.normal(size=12)
    calls = []
    f = lambda x: calls.append(1) or ((x - want) @ m @ (x - want) / 2, m @ (x - want))
    assert np.abs(c.minimised(f, np.zeros(12), 60) - want).max() < 1e-3 and len(calls) <= 60


def test_views_teach_each_other(spark):
    """A view without any label of its own learns from the other one."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    a = np.zeros((600, c.TEXT), dtype=np.float16)
    b = np.zeros((600, c.META), dtype=np.float16)
    a[:, 0], a[:, 1], b[:, 0], b[:, 1] = y, 1, y, 1
    b[:60] = 0
    rows = [(x.tobytes(), z.tobytes(), float(k) if i < 60 else None) for i, (x, z, k) in enumerate(zip(a, b, y, strict=True))]
    df = spark.createDataFrame(rows, "a binary, b binary, label double")
    w = np.zeros(c.TEXT, dtype=np.float32), np.zeros(c.META, dtype=np.float32)
    w[0][:2] = 10, -5
    for _ in range(6):
        w = c.fit_round(df, *w, (1.0, 1.0), True)
    right = (c.sigmoid(b[60:].astype(np.float32) @ w[1]) >= 0.5) == y[60:]
    assert right.mean() > 0.95


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert c.query(spark, str(tmp_path)).count() == 0
