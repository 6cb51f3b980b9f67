"""Toxicity by a weighted finite-state grammar of clauses.

1. Lexicon: from labelled training rows, words and word beginnings (stems, for inflected forms) whose document
   frequency among toxic rows passes a likelihood-ratio test; the shortest pure stem stands for all words below it.
   The fit takes at most ``POSITIVES`` toxic and ``NEGATIVES`` other rows, by the smallest hash of their ids.
2. Scan: an Aho-Corasick automaton of the lexicon and the threat words finds the clauses that matter. Only those are
   tokenised and read by the composed transducers (``transducers.grammar``), which tell direct insults and threats from
   targeted, negated and reported ones.
3. Score: a logistic function of the clause weights by kind, fitted on the same rows.

Labels are read only of rows whose crc32 of the id as text is not 1 modulo 3. Scores use the text alone. The documents
pass once for the fit (a broadcast of bounded size picks its rows) and once for the scores, without an exchange.

Cases: null and empty texts score as texts without a match. Without labels of both kinds the lexicon is empty and every
score is the share of toxic rows (0 without any). A null doc_id is not in training and not held out. An id labelled both
ways counts as toxic. Repeated rows score alike; a label counts once for each row it meets, and at most
``POSITIVES + NEGATIVES`` rows are met, by the smallest hash of id and text. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import transducers as fst
from tessera.llm.common import table, written

POSITIVES, NEGATIVES = 4000, 8000
#: Shortest and longest stem, the least likelihood ratio (chi square of about one in a million), and entries kept.
STEM, RATIO, ENTRIES = (4, 8), 24.0, 5000
#: Share among other rows that an entry may have, of that among toxic ones.
IMPURE = 0.1
THRESHOLD = 0.7

#: Function words of four languages that bear on an insult, and verbs of threat.
TARGETS = "you your youre he she they dich du dir ihr euch sie te tu toi vous tes ton usted ustedes tú ti"
NEGATIONS = "not no never isnt arent nicht kein keine nie ne pas jamais nunca jamás"
REPORTS = "said says told called wrote quoted sagte sagt nannte schrieb dit disait appelait dijo dice llamó escribió"
THREATS = "kill hurt destroy murder töten umbringen tuer frapper matar golpear"

KINDS = ("insult", "threat")
FEATURES = 6
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")


def saturated(x: np.ndarray) -> np.ndarray:
    """Clause weights between 0 and 1: one strong match tells most of what many do."""
    return 1 - np.exp(-x / 2)


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def __post_init__(self):
        self.made = None

    def __getstate__(self):
        return self.words, self.stems, self.weights

    def __setstate__(self, state):
        self.words, self.stems, self.weights = state
        self.made = None

    def machines(self):
        if self.made is None:
            import ahocorasick

            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for w in (*self.words, *self.stems, *THREATS.split()):
                automaton.add_word(w)
            automaton.make_automaton()
            classes = {w: c for c, said in ((fst.TARGET, TARGETS), (fst.NEGATION, NEGATIONS), (fst.REPORT, REPORTS), (fst.THREAT, THREATS)) for w in said.split()}
            self.made = automaton, fst.Reader(fst.Lexicon(classes, self.weight), fst.grammar())
        return self.made

    def weight(self, word: str) -> float:
        """The weight of a word's arc in the lexicon transducer: 0 for words that it doesn't accept."""
        got = self.words.get(word)
        if got is None:
            got = next((self.stems[word[:k]] for k in range(STEM[0], STEM[1] + 1) if word[:k] in self.stems), 0.0)
        return got

    def features(self, text: str | None) -> np.ndarray:
        """Weights of the matched clauses: direct insult, targeted, negated, reported, threat with and without a target."""
        out = np.zeros(FEATURES)
        if not text:
            return out
        low = text.lower()
        automaton, reader = self.machines()
        done = -1
        for end, _ in automaton.iter(low):
            if end <= done:
                continue
            # the clause around the match
            lo = max(low.rfind(c, 0, end + 1) for c in ".!?;:\n") + 1
            hit = CLAUSE.search(low, end + 1)
            hi = hit.start() if hit else len(low)
            done = hi - 1
            for _, marks, weight in reader.read(WORD.findall(low, lo, hi)):
                if "insult" in marks:
                    kind = 3 if "reported" in marks else 2 if "negated" in marks else 1 if "target" in marks else 0
                    out[kind] += weight
                elif "threat" in marks and "negated" not in marks and "reported" not in marks:
                    out[5 if "target" in marks else 4] += weight
        return out

    def score(self, text: str | None) -> float:
        x = saturated(self.features(text))
        z = float(self.weights[0] + self.weights[1:] @ x)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def split(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the rows to fit on: a bounded number, the same ones at every run."""
    known = labels.where("doc_id is not null and toxic is not null").where(split(F.col("doc_id")) != 1)
    # an id with both labels counts as toxic
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(POSITIVES).unionByName(known.where("toxic = 0").orderBy(*order).limit(NEGATIVES))
    rows = written(docs.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select(F.xxhash64("doc_id", "text").alias("place"), "text", "toxic"))
    # ids may repeat: the rows are bounded, too
    if rows.count() > POSITIVES + NEGATIVES:
        rows = written(rows.orderBy("place", "toxic").limit(POSITIVES + NEGATIVES))
    return rows.select("text", "toxic")


def lexicon(rows: DataFrame, n1: int, n0: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log odds; ``rows``: text, toxic."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    each = rows.select("toxic", F.monotonically_increasing_id().alias("row"), F.explode(words).alias("w")).where("length(w) >= 3 and length(w) < 40")
    stems = F.transform(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda k: F.when(F.length("w") >= k, F.substring("w", F.lit(1), k)))
    forms = F.concat(F.array(F.concat(F.col("w"), F.lit("$"))), F.array_compact(stems))
    each = each.select("toxic", F.explode(forms).alias("form"))
    counts = each.groupBy("form").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where("a >= 3 and a > n - a")
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    g = 2 * (a * F.log(a * (n1 + n0) / ((a + b) * n1)) + F.when(b > 0, b * F.log(b * (n1 + n0) / ((a + b) * n0))).otherwise(0.0))
    pure = (b * n1 <= IMPURE * a * n0) & (g >= RATIO)
    top = counts.where(pure).select("form", a.alias("a"), b.alias("b"), g.alias("g")).orderBy(F.desc("g"), "form").limit(ENTRIES).collect()
    odds = {r.form: math.log((r.a + 0.5) / (n1 + 1)) - math.log((r.b + 0.5) / (n0 + 1)) for r in top}
    found_words = {f[:-1]: x for f, x in odds.items() if f.endswith("$")}
    found = {f: x for f, x in odds.items() if not f.endswith("$")}
    # a stem stands for the longer ones; one that is nothing but a word's beginning is that word
    stems_kept = {f: x for f, x in found.items() if not any(f[:k] in found for k in range(STEM[0], len(f)))}
    of_word = {w[:k] for w in found_words for k in range(STEM[0], STEM[1] + 1)}
    counted = {r.form: r.a for r in top}
    several = {f: x for f, x in stems_kept.items() if not (f in of_word and max(counted.get(w + "$", 0) for w in found_words if w.startswith(f)) >= 0.9 * counted[f])}
    return {w: x for w, x in found_words.items() if not any(w[:k] in several for k in range(STEM[0], STEM[1] + 1))}, several


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    rows = training(docs, labels)
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    model = Grammar()
    if not n1 or not n0:
        model.weights[0] = 30.0 if n1 else -30.0
        return model
    model = Grammar(*lexicon(rows, n1, n0))
    points = rows.mapInArrow(_features(model), "toxic int, x array<double>").collect()
    x, y = np.array([p.x for p in points]), np.array([p.toxic for p in points], dtype=float)
    model.weights = logistic(saturated(x), y)
    return model


def _features(model: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.features(t.as_py()).tolist() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 40) -> np.ndarray:
    """Intercept and non-negative slopes by Newton steps with a ridge; slopes of kinds never seen get the mean of the rest."""
    d = np.c_[np.ones(len(x)), x]
    w = np.zeros(d.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    keep = np.eye(d.shape[1]) * ridge
    keep[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + keep, d.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
    seen = (x > 0).any(axis=0)
    if seen.any():
        w[1:][~seen] = w[1:][seen].mean() / 2
    return w


def scored(docs: DataFrame, model: Grammar) -> DataFrame:
    """(doc_id, score) for ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.score(t.as_py()) for t in b.column("text")], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    held = F.coalesce(split(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
