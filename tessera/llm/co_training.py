"""Quality classifier by co-training of two views.

* Text content: hashed trigrams of the text's bytes (square roots of their shares), the share of distinct ones, and how
  far the text can be compressed.
* Page metadata: source, language, stored length and the page's layout: how many lines and paragraphs, how long they
  are, empty and indented lines, white space; as numbers, and as classes of size by themselves and for each source and
  language. No letter, digit or sign of the text is looked at, so that the views are apart.

1. Both views' features of every document are written once, a few hundred bytes each.
2. Round 0 fits each view to the training rows of at most ``FIRST`` labelled ids, by the smallest hash. In each later round a view also learns from the rows that the
   other view is sure of, labelled or not, as the weights before the round say. A fit minimises the weighted logistic
   loss over all rows by L-BFGS: each of its steps is a pass in which tasks add up losses and slopes, so that neither
   files nor partitions decide anything. Nothing but these sums comes to the driver.
3. The views are calibrated and combined by a logistic function of both, fitted to at most ``CALIBRATION`` labelled
   rows that the fits have not seen.

Labels are read only of rows whose crc32 of the id as text is not 1 modulo 3, so that the rest measures accuracy.

Cases: null and empty texts have zero features and are scored by them; null metadata is a value of its own. Without
labels every score is 0.5. A null doc_id has no label. Repeated rows score alike. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small, table, written

BINS, NAMES = 512, 256
TEXT, META = BINS + 4, NAMES + 14
ROUNDS, SURE, PSEUDO = 3, 0.95, 0.2
#: Weight of the squared weights, and passes of the first fit and of a round.
RIDGE, PASSES, MORE_PASSES = 1e-5, 24, 8
FIRST, CALIBRATION = 20_000, 4000
THRESHOLD = 0.5

_KEY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def text_features(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(TEXT, dtype=np.float32)
    if len(b) >= 3:
        h = b[:-2] * _KEY[0] ^ b[1:-1] * _KEY[1] ^ b[2:] * _KEY[2]
        counts = np.bincount((h ^ (h >> np.uint32(15))) % BINS, minlength=BINS)
        out[:BINS] = 4 * np.sqrt(counts / counts.sum())
        out[BINS] = (counts > 0).sum() / min(BINS, counts.sum())
        out[BINS + 1] = 4 * len(zlib.compress(raw, 1)) / (len(raw) + 20)
        out[BINS + 2] = np.log1p(len(raw)) / 5
    out[BINS + 3] = 1
    return out


def _hash(kind: str, value: str | None) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % NAMES


def meta_features(text: str, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META, dtype=np.float32)
    out[_hash("source", source)] += 0.5
    out[_hash("lang", lang)] += 0.5
    n = len(text)
    rows = text.split("\n")
    sizes = np.array([len(r) for r in rows], dtype=np.float64)
    empty = sum(not r.strip() for r in rows)
    indented = sum(r[:1] in (" ", "\t") for r in rows)
    blocks = sum(bool(r.strip()) and not (i and rows[i - 1].strip()) for i, r in enumerate(rows))
    blank = text.count(" ") + text.count("\t") + len(rows) - 1
    # classes of size, as a linear view can't bend
    step = lambda x, by=2.0: int(by * np.log1p(x))
    for name, size in (("n", step(n)), ("line", step(sizes.mean())), ("rows", step(len(rows))), ("spread", step(sizes.std())), ("blank", int(40 * blank / max(1, n))), ("stored", step(max(0, n_chars or 0)))):
        out[_hash(name, f"{size}")] += 0.5
        out[_hash(name, f"{size} {lang}")] += 0.25
        out[_hash(name, f"{size} {source}")] += 0.25
    out[NAMES:] = [
        1, np.log1p(n) / 5, np.log1p(n_chars if n_chars is not None and n_chars >= 0 else 0) / 5, n_chars is None, np.log1p(len(rows)) / 3, np.log1p(sizes.mean()) / 5,
        np.log1p(sizes.std()) / 5, np.log1p(sizes.max()) / 5, empty / len(rows), indented / len(rows), np.log1p(blocks) / 3, 3 * blank / max(1, n), len(np.unique(sizes)) / len(rows), np.log1p(blank) / 5,
    ]
    return out


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b): the two views' features as half floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for t, s, lang, n in zip(*(batch.column(c) for c in ("text", "source", "lang", "n_chars")), strict=True):
                text = t.as_py() or ""
                a.append(text_features(text).astype(np.float16).tobytes())
                b.append(meta_features(text, s.as_py(), lang.as_py(), n.as_py()).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["doc_id", "a", "b"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    return chosen.mapInArrow(run, "doc_id long, a binary, b binary")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.float16).reshape(-1, width).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimised(f, x: np.ndarray, passes: int, memory: int = 8) -> np.ndarray:
    """L-BFGS from ``x`` on; ``f`` gives value and slopes and is called about ``passes`` times. The best point that was met."""
    value, slope = f(x)
    before: list[tuple[np.ndarray, np.ndarray]] = []
    left = passes - 1
    while left > 0 and np.abs(slope).max() > 1e-7:
        d, kept = slope.copy(), []
        for s, y in reversed(before):
            kept.append(s @ d / (s @ y))
            d -= kept[-1] * y
        d *= before[-1][0] @ before[-1][1] / (before[-1][1] @ before[-1][1]) if before else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y), k in zip(before, reversed(kept), strict=True):
            d += s * (k - y @ d / (s @ y))
        size = 1.0
        while left > 0:
            left -= 1
            new_value, new_slope = f(x - size * d)
            if new_value <= value - 1e-4 * size * (slope @ d):
                break
            size *= 0.3
        else:
            break
        s, y = -size * d, new_slope - slope
        x, value, slope = x - size * d, new_value, new_slope
        if s @ y > 1e-12:
            before = [*before[1 - memory :], (s, y)]
    return x


def sums(rows: DataFrame, old: tuple[np.ndarray, np.ndarray], now: np.ndarray, balance: tuple[float, float], pseudo: bool) -> np.ndarray:
    """Slopes of both views' losses at the weights ``now`` over ``rows`` (a, b, label or null), then both losses and weights of rows.

    Pseudo-labels are those of the ``old`` weights.
    """
    sent = rows.sparkSession.sparkContext.broadcast((*old, now[:TEXT].astype(np.float32), now[TEXT:].astype(np.float32)))
    size = TEXT + META + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *before, wa, wb = sent.value
        total = np.zeros(size)
        for batch in batches:
            x = (matrix(batch.column("a"), TEXT), matrix(batch.column("b"), META))
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float32)
            known = ~np.isnan(label)
            p = [sigmoid(f @ w) for f, w in zip(x, before, strict=True)] if pseudo else [np.full(len(known), 0.5)] * 2
            for view, (w, at) in enumerate(((wa, 0), (wb, TEXT))):
                other = p[1 - view]
                sure = ~known & ((other >= SURE) | (other <= 1 - SURE))
                use = np.flatnonzero(known | sure)
                y = np.where(known, np.nan_to_num(label), other >= 0.5)[use]
                weight = np.where(known, 1.0, PSEUDO)[use] * np.where(y > 0, balance[1], balance[0])
                f = x[view][use]
                z = np.clip((f @ w).astype(np.float64), -30, 30)
                total[at : at + len(w)] += f.T.astype(np.float64) @ (weight * (1 / (1 + np.exp(-z)) - y))
                total[TEXT + META + view] += (weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum()
                total[TEXT + META + 2 + view] += weight.sum()
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "x"])

    out = np.zeros(size)
    for r in rows.select("a", "b", "label").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # a row for each weight
        out[r.at] = r.x
    return out


def fit_round(rows: DataFrame, a: np.ndarray, b: np.ndarray, balance: tuple[float, float], pseudo: bool, passes: int = MORE_PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Both views' weights after a round over ``rows`` (a, b, label or null)."""

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        got = sums(rows, (a, b), w, balance, pseudo)
        n = np.maximum(got[-2:], 1e-9)
        slope = np.concatenate([got[:TEXT] / n[0], got[TEXT : TEXT + META] / n[1]])
        return (got[-4:-2] / n).sum() + RIDGE / 2 * (w @ w), slope + RIDGE * w

    w = minimised(f, np.concatenate([a, b]).astype(np.float64), passes).astype(np.float32)
    return w[:TEXT], w[TEXT:]


def views(rows: DataFrame, a: np.ndarray, b: np.ndarray) -> DataFrame:
    """``rows`` with the two views' log odds in place of their features."""
    sent = rows.sparkSession.sparkContext.broadcast((a, b))
    keep = [f for f in rows.schema.fields if f.name not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            za = matrix(batch.column("a"), TEXT) @ w[0]
            zb = matrix(batch.column("b"), META) @ w[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(za.astype(np.float64)), pa.array(zb.astype(np.float64))], names=[*(f.name for f in keep), "za", "zb"])

    said = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep)
    return rows.mapInArrow(run, f"{said}, za double, zb double")


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Intercept and slopes of the views' log odds by Newton steps; slopes are not negative."""
    d = np.c_[np.ones(len(z)), z]
    w = np.array([0.0, *[1 / max(1, z.shape[1])] * z.shape[1]])
    for _ in range(rounds):
        p = sigmoid(d @ w)
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + 0.1 * np.eye(len(w)), d.T @ (y - p) - 0.1 * w)
        w = w + np.clip(step, -1, 1)
        w[1:] = np.maximum(w[1:], 0)
    return w


def later_of(doc_id: Column) -> Column:
    """Whether an id's label is kept for the calibration."""
    return F.crc32(F.concat(F.lit("calibrate"), doc_id.cast("string")).cast("binary")) % 4 == 0


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, text_score, page_score, score) for every row of ``docs``."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when(F.col("quality") >= 0.5, 1.0).otherwise(0.0)).alias("quality"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    later = later_of(F.col("doc_id"))
    known = written(known)
    rows = written(featured(docs)).join(small(known), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    rows = rows.withColumn("held_out", F.coalesce(fold == 1, F.lit(False)))
    seen = rows.withColumn("label", F.when(~F.col("held_out") & ~later, F.col("quality")))
    n = {r.label: r.n for r in seen.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(0.0, 0), n.get(1.0, 0)
    a, b = np.zeros(TEXT, dtype=np.float32), np.zeros(META, dtype=np.float32)
    if bad and good:
        balance = ((bad + good) / (2 * bad), (bad + good) / (2 * good))
        # ids are picked from the labels alone, so that no task gathers features
        usable = known.where((F.crc32(F.col("_id").cast("string").cast("binary")) % 3 != 1) & ~later_of(F.col("_id")))
        some = written(usable.orderBy(F.xxhash64("_id"), "_id").limit(FIRST).select(F.col("_id").alias("_first")))
        first = written(seen.where("label is not null").join(small(some), F.col("doc_id") == F.col("_first"), "left_semi").select("a", "b", "label"))
        a, b = fit_round(first, a, b, balance, False, PASSES)
        for _ in range(ROUNDS):
            a, b = fit_round(seen, a, b, balance, True)
    fresh = views(rows.where(~F.col("held_out") & later & F.col("quality").isNotNull()).select("doc_id", "quality", "a", "b"), a, b)
    some = fresh.orderBy(F.xxhash64("doc_id"), "doc_id", "za").limit(CALIBRATION).collect()
    y = np.array([r.quality for r in some])
    each, both = [np.array([0.0, 1.0])] * 2, np.array([0.0, 0.5, 0.5])
    if len(set(y.tolist())) == 2:
        z = np.array([(r.za, r.zb) for r in some])
        each = [calibrate(z[:, [k]], y) for k in (0, 1)]
        both = calibrate(z, y)
    logistic = lambda w, *z: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((float(c) * x for c, x in zip(w[1:], z, strict=True)), F.lit(float(w[0])))))))
    out = views(rows.select("doc_id", "held_out", "a", "b"), a, b)
    za, zb = F.col("za"), F.col("zb")
    return out.select("doc_id", "held_out", logistic(each[0], za).alias("text_score"), logistic(each[1], zb).alias("page_score"), logistic(both, za, zb).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("kept", F.col("score") >= THRESHOLD)
