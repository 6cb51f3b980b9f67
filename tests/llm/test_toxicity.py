import random
import zlib

from tessera.llm import toxicity as t
from tessera.llm import transducers as fst


def test_machines_compose():
    g = fst.grammar()
    i, n, r, y, h, o = fst.INSULT, fst.NEGATION, fst.REPORT, fst.TARGET, fst.THREAT, fst.OTHER
    marks = lambda s: [(p, sorted(m)) for p, m in g.read(s)]
    assert marks([o, i, o]) == [(1, ["insult"])]
    assert marks([n, o, i]) == [(2, ["insult", "negated"])]
    assert marks([n, o, o, o, i]) == [(4, ["insult"])]
    assert marks([y, i, i]) == [(1, ["insult", "target"]), (2, ["insult", "target"])]
    assert marks([r, *[o] * 9, i]) == [(10, ["insult", "reported"])]
    assert marks([y, h]) == [(1, ["target", "threat"])]
    assert marks([]) == []


def test_weights_are_added_along_composed_arcs():
    entries = {"glorp": 2.5, "zwick": -1.5}
    reader = fst.Reader(fst.Lexicon({"you": fst.TARGET, "kill": fst.THREAT, "not": fst.NEGATION, "glorp": fst.THREAT}, lambda w: entries.get(w, 0.0)), fst.grammar())
    got = [(i, sorted(marks), w) for i, marks, w in reader.read("you glorp and not zwick or kill".split())]
    assert got == [(1, ["insult", "target"], 2.5), (4, ["insult", "negated", "target"], -1.5), (6, ["negated", "threat"], 1.0)]
    both = fst.Composed(fst.emits(fst.INSULT, "a", 2.0), fst.emits(fst.INSULT, "b", 0.5))
    assert both.weighed([(fst.OTHER, 1.0), (fst.INSULT, 1.0)]) == [(1, frozenset("ab"), 3.5)]


def corpus(n=900):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ba", "lo", "ni", "re", "tu", "sa", "ke"]) for _ in range(rng.randint(2, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["glorp", "zwick" + word(), "zwick" + word()])
        docs.append((i, " ".join(w) + ".", "x", 0.5))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus()
    docs += [(5000, None, "x", 0.0), (5001, "", "x", 0.0), (None, "glorp glorp", "x", 0.0), (5, docs[5][1], "x", 0.0), (5002, "ba lo " * 30000 + "glorp.", "x", 0.0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, x) for i, x in labels] + [(None, None, None), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = t.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.5 and by[5002].predicted == 1
    assert not by[None].held_out and by[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame([(i, x) for i, x, *_ in docs], "doc_id long, text string")
    flipped = [(i, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, x in labels]
    a, b = (t.fit(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (a.words, a.stems, a.weights.tolist()) == (b.words, b.stems, b.weights.tolist())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert t.query(spark, str(tmp_path)).count() == 0
