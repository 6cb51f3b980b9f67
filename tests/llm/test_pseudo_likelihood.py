import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import pseudo_likelihood as p


def softmax(z):
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def brute(vocab, net, text):
    """A word at a time, each digit given the context and the digits before it."""
    w, x = p.words(text), net.w
    code = [vocab.code_of(v)[0] for v in w]
    total = 0.0
    for i, v in enumerate(w):
        h = x["bias"].astype(float).copy()
        for k, o in enumerate(p.OFFSETS):
            at = code[i + o] if 0 <= i + o < len(code) else None
            h += x["inputs"][p.INPUTS - 1 if at is None else at if at < p.KNOWN else p.KNOWN + (at - p.KNOWN) // p.CLASSES] * x["at"][k]
        h, c = np.tanh(h), code[i]
        if c < p.OWN:
            first, second, third = c, None, None
        elif c < p.KNOWN:
            first, second, third = p.OWN + (c - p.OWN) // p.CLASSES, (c - p.OWN) % p.CLASSES, None
        else:
            first, second, third = p.OWN + p.BANDS + (c - p.KNOWN) // p.CLASSES**2, (c - p.KNOWN) // p.CLASSES % p.CLASSES, (c - p.KNOWN) % p.CLASSES
        total += math.log(softmax(h @ x["out1"] + x["prior1"])[first])
        if second is not None:
            total += math.log(softmax((h * x["gate2"][first - p.OWN]) @ x["out2"] + x["prior2"][first - p.OWN])[second])
        if third is not None:
            g = (c - p.KNOWN) // p.CLASSES
            total += math.log(softmax((h * x["gate3"][g]) @ x["out3"] + x["prior3"][g])[third])
        total += vocab.code_of(v)[1]
    return total


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    # a grammar with order: determiner, adjective, noun, verb
    kinds = [["the", "a"], ["red", "big", "odd"], ["cat", "dog", "cow", "hen"], ["runs", "eats", "sits"]]
    return [" ".join(rng.choice(kinds[i % 4]) for i in range(rng.randint(40, 120))) for _ in range(800)]


def test_scores(spark, tmp_path, corpus):
    texts = [*corpus, None, "", "The", "unseen zzzzzzzzzzzzzzzzzzzzz words", "the red cat runs " * 9000]
    rows = [(i, t, 0.0) for i, t in enumerate(texts)] + [(None, corpus[0], 0.0), (0, corpus[0], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    narrow = docs.select("doc_id", "text")
    vocab = p.vocabulary(narrow)
    coded, weights = p.fit(narrow)
    net = p.Network(weights)
    got = p.scored(coded, weights).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in [0, 5, 17, 800, 801, 802, 803]:
        assert by[i].log_prob == pytest.approx(brute(vocab, net, texts[i]), rel=1e-4, abs=1e-4)
        assert by[i].n_words == len(p.words(texts[i]))
    assert by[800].score == by[801].score == 0
    assert by[None].log_prob == pytest.approx(by[0].log_prob)
    # the network knows the order: better than single counts on ordered text, worse on the same words shuffled
    c = Counter(w for t in texts for w in p.words(t))
    n = sum(c.values())
    single = np.mean([math.log(c[w] / n) for w in p.words(texts[5])])
    assert by[5].score > single + 0.5
    w = p.words(texts[5])
    random.Random(1).shuffle(w)
    assert brute(vocab, net, b" ".join(w).decode()) / len(w) < by[5].score - 0.5


def test_counts_are_of_all_rows(spark, corpus):
    docs = spark.createDataFrame([(t,) for t in corpus], "text string")
    got = {bytes(r.word): r.n for r in p.counts(docs).collect()}
    assert got == Counter(w for t in corpus for w in p.words(t))


def many_words(rng, n):
    word = lambda: "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_shares_sum_to_one(spark):
    texts = many_words(random.Random(4), 600)
    vocab = p.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len(vocab.known) == p.KNOWN
    sums = Counter()
    for w in {w for t in texts for w in p.words(t)}:
        code, share = vocab.code_of(w)
        sums[code] += math.exp(share)
    assert all(s == pytest.approx(1) for s in sums.values())
    assert vocab.mass.sum() == sum(len(t.split()) for t in texts)


def test_partitions_do_not_matter(spark):
    rows = list(enumerate(many_words(random.Random(6), 500)))
    scores = []
    for parts in (1, 7):
        random.Random(parts).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        scores.append({r.doc_id: r.score for r in p.scored(*p.fit(docs)).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(scores[0][k] == pytest.approx(scores[1][k], rel=1e-5) for k in scores[0])


def test_gradient(spark):
    """A step moves against the gradient that differences give."""
    rng = np.random.default_rng(1)
    near, code = rng.integers(0, p.INPUTS, (4, 40)), np.r_[rng.integers(0, p.KNOWN, 20), rng.integers(p.KNOWN, p.KNOWN + 4096, 20)]
    flat = rng.normal(0, 0.3, p.SIZE)
    seen = np.zeros(p.SIZE)
    p.Network(flat.copy()).step(near, code, seen)
    grad, loss = np.sqrt(seen), lambda x: -p.Network(x).log_probs(near, code).mean()
    some = np.r_[np.argsort(grad)[-15:], rng.choice(np.flatnonzero(grad > 1e-4), 15)]
    for k in some:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs(loss(up) - loss(down)) / 2e-5 == pytest.approx(grad[k], rel=1e-3, abs=1e-7)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert p.query(spark, str(tmp_path)).count() == 0


def test_every_word_is_a_target_once(spark):
    coded = spark.createDataFrame([(1, bytearray(np.arange(p.OWN, dtype=np.uint16).tobytes()), 0.0)], "doc_id long, codes binary, inner double")
    # from weights of zero a step raises the priors of its targets alone
    raised = Counter()
    for turn in range(p.ROUNDS):
        raised.update(np.flatnonzero(p.Network(p.trained(coded, np.zeros(p.SIZE, dtype=np.float32), turn, 1)).w["prior1"] > 0).tolist())
    assert raised == Counter(range(p.OWN))
