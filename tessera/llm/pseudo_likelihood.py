"""Language-model scores by masked pseudo-likelihood.

A window network predicts every word from the two words before and the two after it. A word has a code of up to three
digits, and each digit has a softmax that depends on the context and on the digits before it:

* the ``OWN`` most frequent words are a first digit of their own, the next ``BANDS * CLASSES`` have two digits;
* all others have three: the first two by a word's ending, which tells its language and form, the third by its hash.
  Words that share all digits share the probability by their counts, which are kept by hash in a table that grows with
  the corpus (up to ``MOST_BITS``; words that share a place there count alike).

A document's score is the sum of the log probabilities, and its mean for each word.

1. Counts: words are counted inside the tasks and summed over the whole corpus; every document counts. The driver gets
   the most frequent words and the table of counts, of at most 2 ** ``MOST_BITS`` numbers.
2. Codes: each document is written once as the codes of its words, two bytes each, with the sum of the log shares. What
   follows reads these bytes and not the texts.
3. Training, in numpy: documents fall into shards by a hash of what they hold, of about ``SHARD`` words and in a set order.
   In each round every shard runs stochastic gradient steps from the common weights, at every ``STRIDE``-th word (from
   another start each round, so that over the rounds each word is the target once); the weights are averaged by the number
   of words. So the result doesn't hang on files, partitions or cores. The driver receives one set of weights.
4. Scores: one pass over the codes.

Cases: null and empty texts have no words, sum 0 and mean 0. Repeated rows score alike. A null doc_id is carried along.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written

#: First digits: of words of their own, of words with two digits, of words with three; digits in all.
OWN, BANDS, WIDE, CLASSES = 8, 8, 16, 32
KNOWN, GROUPS = OWN + BANDS * CLASSES, WIDE * CLASSES
CODE_BITS = (GROUPS * CLASSES - 1).bit_length()
#: Codes that a neighbour is seen as: a known word or the first two digits; the last is beyond the text's end.
INPUTS = KNOWN + GROUPS + 1
#: Bits of the table of counts.
LEAST_BITS, MOST_BITS = 16, 22
SIDE, HIDDEN = 2, 16
ROUNDS, STRIDE, BATCH, RATE, SHARD = 2, 2, 4096, 0.25, 2_000_000
#: Distinct words that a task counts before it hands them on and that it remembers the codes of; words scored together, and
#: words that training takes in random order.
HELD, REMEMBERED, AT_ONCE, MIXED = 300_000, 1_000_000, 1 << 15, 1 << 18

OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
SHAPES = {
    "inputs": (INPUTS, HIDDEN), "at": (len(OFFSETS), HIDDEN), "bias": (HIDDEN,), "out1": (HIDDEN, CLASSES), "prior1": (CLASSES,),
    "gate2": (BANDS + WIDE, HIDDEN), "out2": (HIDDEN, CLASSES), "prior2": (BANDS + WIDE, CLASSES),
    "gate3": (GROUPS, HIDDEN), "out3": (HIDDEN, CLASSES), "prior3": (GROUPS, CLASSES),
}
SIZE = sum(math.prod(s) for s in SHAPES.values())
ONES = np.ones(CLASSES, dtype=np.float32)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def spread(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 10)


def wide_code(word: bytes, h: int) -> int:
    """The code of a word that isn't known, less ``KNOWN``: by its last two bytes, its last three, and its hash ``h``."""
    return (zlib.crc32(word[-2:]) % WIDE * CLASSES + zlib.crc32(word[-3:]) % CLASSES) * CLASSES + (h >> 40) % CLASSES


def place(wide: int, h: int, bits: int) -> int:
    """Where the table of 2 ** ``bits`` numbers holds a word of hash ``h`` and a wide code."""
    of_code = bits - CODE_BITS
    return wide << of_code | h & (1 << of_code) - 1


def digits(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First, second and third digit, and the group (the first two digits) of codes with three; -1 where there is none."""
    code = code.astype(np.int32)
    rest = code - KNOWN
    first = np.where(code < OWN, code, np.where(rest < 0, OWN + (code - OWN) // CLASSES, OWN + BANDS + rest // (CLASSES * CLASSES)))
    second = np.where(code < OWN, -1, np.where(rest < 0, (code - OWN) % CLASSES, rest // CLASSES % CLASSES))
    return first, second, np.where(rest < 0, -1, rest % CLASSES), np.where(rest < 0, -1, rest // CLASSES)


@dataclass
class Vocabulary:
    """``known``: codes of the most frequent words; ``table``: mean count of the words of a wide code and a hash; ``total``: words
    of each wide code."""

    known: dict[bytes, int]
    table: np.ndarray
    total: np.ndarray
    mass: np.ndarray

    def __post_init__(self):
        self.bits = int(len(self.table)).bit_length() - 1
        self.seen = Seen(self)

    def __getstate__(self):
        return self.known, self.table, self.total, self.mass

    def __setstate__(self, state):
        self.known, self.table, self.total, self.mass = state
        self.__post_init__()

    def code_of(self, word: bytes) -> tuple[int, float]:
        """Its code, and the log of its share of the words of that code."""
        got = self.known.get(word)
        if got is not None:
            return got, 0.0
        h = spread(word)
        wide = wide_code(word, h)
        n = self.table[place(wide, h, self.bits)]
        return KNOWN + wide, math.log(min(1.0, max(n, 1) / max(self.total[wide], 1)))

    def encode(self, text: str | None) -> tuple[bytes, float]:
        found = words(text)
        if len(self.seen) > REMEMBERED:
            self.seen = Seen(self)
        at = np.fromiter(map(self.seen.__getitem__, found), dtype=np.int64, count=len(found))
        return self.seen.code[at].tobytes(), float(self.seen.share[at].sum())


class Seen(dict):
    """Words that a task has met, by number; ``code`` and ``share`` by that number."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.of, self.code, self.share = vocabulary, np.zeros(1 << 12, dtype=np.uint16), np.zeros(1 << 12)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.code):
            self.code, self.share = np.resize(self.code, 2 * n), np.resize(self.share, 2 * n)
        self.code[n], self.share[n] = self.of.code_of(word)
        self[word] = n
        return n


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column("text"):
                held.update(words(t.as_py()))
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    every = written(counts(docs))
    top = every.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    known = {bytes(r.word): i for i, r in enumerate(top)}
    distinct = every.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * distinct).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w.as_py() for w in batch.column("word")]
            keep = [i for i, w in enumerate(found) if w not in known]
            h = [spread(found[i]) for i in keep]
            wide = [wide_code(found[i], x) for i, x in zip(keep, h, strict=True)]
            at = pa.array([place(c, x, bits) for c, x in zip(wide, h, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([at, pa.array(wide, pa.int32()), batch.column("n").take(pa.array(keep, pa.int64()))], names=["place", "code", "n"])

    dealt = written(every.mapInArrow(run, "place int, code int, n long"))
    held, total = np.zeros(1 << bits, dtype=np.float32), np.zeros(GROUPS * CLASSES)
    for into, by, of in ((held, "place", F.avg), (total, "code", F.sum)):
        got = dealt.groupBy(by).agg(of("n").alias("n")).toArrow()
        into[got.column(by).to_numpy()] = got.column("n").to_numpy()
    mass = np.zeros(KNOWN + GROUPS * CLASSES)
    mass[: len(top)] = [r.n for r in top]
    mass[KNOWN:] = total
    return Vocabulary(known, held, total, mass)


def codes(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, codes, inner)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.encode(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "codes", "inner"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, codes binary, inner double")


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def summed_by(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups that occur and the sum of each one's rows."""
    if rows.shape[0] > 40 * (groups := int(group.max()) + 1):
        # few groups: a product with their indicators
        return np.arange(groups), (group == np.arange(groups)[:, None]).astype(rows.dtype) @ rows
    order = np.argsort(group, kind="stable")
    in_order = group[order]
    first = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
    return in_order[first], np.add.reduceat(rows[order], first, axis=0)


class Network:
    """``near``: inputs at ``OFFSETS`` of each word; ``code``: its code."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.w = flat, views(flat)

    @staticmethod
    def start(mass: np.ndarray) -> np.ndarray:
        """Small random weights; the biases give each digit its share in the corpus."""
        flat = np.random.default_rng(0).normal(0, 0.1, SIZE).astype(np.float32)
        w = views(flat)
        w["bias"][:] = 0
        for name in ("at", "gate2", "gate3"):
            w[name] += 1
        first, second, third, group = digits(np.arange(len(mass)))
        for name, held, row, digit in (("prior1", first >= 0, None, first), ("prior2", second >= 0, first - OWN, second), ("prior3", third >= 0, group, third)):
            n = np.full(w[name].shape, 0.5)
            np.add.at(n, digit[held] if row is None else (row[held], digit[held]), mass[held])
            w[name][:] = np.log(n / n.sum(axis=-1, keepdims=True))
        return flat

    def hidden(self, near: np.ndarray) -> np.ndarray:
        h = np.repeat(self.w["bias"][None], near.shape[1], axis=0)
        for x, by in zip(near, self.w["at"], strict=True):
            h += self.w["inputs"][x] * by
        return np.tanh(h, out=h)

    def levels(self, h: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each digit: its number, the words that have it, their gated hidden layer, gate and digit."""
        first, second, third, group = digits(code)
        yield 1, slice(None), h, None, first
        for k, digit, gate in ((2, second, first - OWN), (3, third, group)):
            some = np.flatnonzero(digit >= 0)
            if len(some):
                yield k, some, h[some] * self.w[f"gate{k}"][gate[some]], gate[some], digit[some]

    def logits(self, k: int, h: np.ndarray, gate: np.ndarray | None) -> np.ndarray:
        """Bounded, so that exp can't overflow and no sum of it can vanish."""
        z = h @ self.w[f"out{k}"]
        z += self.w[f"prior{k}"] if gate is None else self.w[f"prior{k}"][gate]
        return np.clip(z, -60, 60, out=z)

    def log_probs(self, near: np.ndarray, code: np.ndarray) -> np.ndarray:
        h, out = self.hidden(near), np.zeros(len(code))
        for k, some, gated, gate, digit in self.levels(h, code):
            z = self.logits(k, gated, gate)
            own = z[np.arange(len(digit)), digit]
            out[some] += own - np.log(np.exp(z, out=z) @ ONES)
        return out

    def step(self, near: np.ndarray, code: np.ndarray, seen: np.ndarray) -> None:
        """A step of Adagrad; ``seen`` gathers the squares of the gradient. Rows that a batch doesn't meet are left alone."""
        n, s = len(code), views(seen)

        def descend(name: str, g: np.ndarray, rows=slice(None)) -> None:
            s[name][rows] += g * g
            self.w[name][rows] -= RATE * g / (np.sqrt(s[name][rows]) + 1e-6)

        h = self.hidden(near)
        back, todo = np.zeros_like(h), []
        for k, some, gated, gate, digit in self.levels(h, code):
            p = self.logits(k, gated, gate)
            np.exp(p, out=p)
            p *= (1 / (n * (p @ ONES)))[:, None]
            p[np.arange(len(digit)), digit] -= 1 / n
            d = p @ self.w[f"out{k}"].T
            todo.append((f"out{k}", gated.T @ p, slice(None)))
            if gate is None:
                todo.append((f"prior{k}", p.sum(axis=0), slice(None)))
                back += d
            else:
                rows, g = summed_by(gate, np.concatenate([p, d * h[some]], axis=1))
                todo += [(f"prior{k}", g[:, :CLASSES], rows), (f"gate{k}", g[:, CLASSES:], rows)]
                back[some] += d * self.w[f"gate{k}"][gate]
        d = back * (1 - h * h)
        todo.append(("bias", d.sum(axis=0), slice(None)))
        todo.append(("at", np.stack([(self.w["inputs"][x] * d).sum(axis=0) for x in near]), slice(None)))
        rows, g = summed_by(near.ravel(), (self.w["at"][:, None, :] * d).reshape(-1, HIDDEN))
        todo.append(("inputs", g, rows))
        for name, g, rows in todo:
            descend(name, g, rows)


def windows(texts: list[bytes], at_once: int, turn: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(neighbours' inputs, code, text number) of every word, ``at_once`` together; beyond a text's ends stands an input of
    its own. With ``turn`` only that round's words, in a random order."""
    n = np.array([len(t) // 2 for t in texts], dtype=np.int64)
    code = np.frombuffer(b"".join(texts), dtype=np.uint16)
    which = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    flat = np.full(len(code) + SIDE * (len(texts) + 1), INPUTS - 1, dtype=np.int16)
    wide = code.astype(np.int32) - KNOWN
    place_of = np.arange(len(code), dtype=np.int32) + SIDE * (1 + which)
    flat[place_of] = np.where(wide < 0, code, KNOWN + wide // CLASSES)
    picked = None if turn is None else np.random.default_rng(turn).permutation(np.arange(turn * STRIDE // ROUNDS % STRIDE, len(code), STRIDE))
    for lo in range(0, len(code) if picked is None else len(picked), at_once):
        part = slice(lo, lo + at_once) if picked is None else picked[lo : lo + at_once]
        at = place_of[part]
        yield np.stack([flat[at + k] for k in OFFSETS]), code[part], which[part]


def pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in runs of about ``AT_ONCE`` words: (number of the first, texts)."""
    run, first, size = [], 0, 0
    for i, t in enumerate(column):
        run.append(t.as_py())
        size += len(run[-1]) // 2
        if size >= AT_ONCE:
            yield first, run
            run, first, size = [], i + 1, 0
    if run:
        yield first, run


def trained(coded: DataFrame, start: np.ndarray, turn: int, shards: int) -> np.ndarray:
    """The average of the shards' weights after a round from ``start``."""
    sent = coded.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, net, seen, total = None, None, None, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE, dtype=np.int32)), pa.array(net.flat.astype(np.float64) * total), pa.array(np.full(SIZE, total, dtype=np.int64))], names=["at", "x", "n"])

        left: list[bytes] = []
        size = 0
        for batch in _ended(batches):
            shard_of = batch.column("shard").to_numpy() if batch is not None else np.array([-1])
            cuts = np.r_[0, np.flatnonzero(np.diff(shard_of)) + 1, len(shard_of)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if shard_of[lo] != now:
                    if left:
                        total += _steps(net, seen, left, turn)
                    if total:
                        yield out()
                    now, net, seen, total, left, size = shard_of[lo], Network(sent.value.copy()), np.full(SIZE, 1e-6, dtype=np.float32), 0, [], 0
                if batch is None:
                    return
                for t in batch.column("codes").slice(lo, hi - lo):
                    left.append(t.as_py())
                    size += len(left[-1]) // 2
                    if size >= MIXED:
                        total += _steps(net, seen, left, turn)
                        left, size = [], 0

    dealt = coded.select(F.pmod(F.xxhash64("doc_id", "codes"), F.lit(shards)).alias("shard"), "doc_id", "codes").repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "codes")
    sums = dealt.select("shard", "codes").mapInArrow(run, "at int, x double, n long").groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
    out = start.copy()
    out[sums.column("at").to_numpy()] = sums.column("x").to_numpy()
    return out


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _steps(net: Network, seen: np.ndarray, texts: list[bytes], turn: int) -> int:
    """Gradient steps over some texts; the number of words."""
    n = 0
    for near, code, _ in windows(texts, BATCH, turn):
        net.step(near, code, seen)
        n += len(code)
    return n


def scored(coded: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, n_words, log_prob, score) from ``coded``."""
    sent = coded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(sent.value)
        for batch in batches:
            sums = np.asarray(batch.column("inner").to_numpy(zero_copy_only=False), dtype=np.float64).copy()
            n = np.zeros(len(sums), dtype=np.int64)
            for first, texts in pieces(batch.column("codes")):
                for near, code, which in windows(texts, 2048):
                    sums[first : first + len(texts)] += np.bincount(which, weights=net.log_probs(near, code), minlength=len(texts))
                n[first : first + len(texts)] = [len(t) // 2 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(sums), pa.array(sums / np.maximum(n, 1))], names=["doc_id", "n_words", "log_prob", "score"])

    return coded.select("doc_id", "codes", "inner").mapInArrow(run, "doc_id long, n_words long, log_prob double, score double")


def fit(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The written codes of ``docs`` (doc_id, text) and the network's weights."""
    vocab = vocabulary(docs)
    coded = written(codes(docs, vocab))
    weights = Network.start(vocab.mass)
    shards = int(vocab.mass.sum()) // SHARD + 1
    for turn in range(ROUNDS):
        weights = trained(coded, weights, turn, shards)
    return coded, weights


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(*fit(table(spark, sf_dir, "documents").select("doc_id", "text")))
