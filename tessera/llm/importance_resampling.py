"""Resampling of documents towards a target's distribution of hashed word features.

1. Features are all runs of 1 to ``runs`` words, told by a bucket: the CRC-32 of the run's bytes modulo ``buckets``.
2. Each task puts the texts it reads into a trie of words. A node stands for a run; it holds the run's count and the
   state of its CRC, so that a longer run goes on from its parent's state. The trie's counts are summed into bucket
   totals, which is all that leaves the task. A trie over ``NODES`` nodes is summed up and begun anew.
3. Totals of the documents and of the target give each bucket a gain. There are ``buckets`` of them whatever the input.
4. A second pass walks the same paths with the gains attached to the nodes: a document's weight is their sum.
5. Seeded Gumbel noise is added. The best documents are ranked by ranges of scores: each range is ranked by itself, and
   the sizes of those before it are added.

Cases: a null text has no words, weight 0. A null ``doc_id`` is seeded by the empty string and comes last among equal
scores. Repeated rows are separate documents; equal scores of one id are ranked in any order. Other columns are not
looked at. Empty tables count nothing: without a target or documents all gains come from the smoothing alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import small, table, written

#: Nodes of a trie before it is summed up and begun anew.
NODES = 1 << 19

#: A-Z become lower case; of ASCII only digits and letters belong to words.
_TO = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Draw:
    runs: int = 1
    buckets: int = 10_000
    scale: int = 1000
    seed: str = "2024"
    least_words: int = 20
    percent: int = 10


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO).split()


class _Level(dict):
    """Children by key; one that is missing is made."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        node = self[key] = self.make(key)
        return node


class Trie:
    """Runs of words as paths. ``crc`` and ``count`` are by node; ``gains``, if given, are attached by the CRC's bucket."""

    def __init__(self, runs: int, buckets: int, gains: np.ndarray | None = None):
        self.runs, self.buckets, self.gains = runs, buckets, gains
        self.crc: list[int] = []
        self.first = _Level(lambda word: self._node(zlib.crc32(word)))
        self.below = _Level(lambda key: self._node(zlib.crc32(b" " + key[1], self.crc[key[0]])))
        self.count = np.zeros(1024, dtype=np.int64)
        self.gain = np.zeros(1024, dtype=np.int64)

    def _node(self, crc: int) -> int:
        n = len(self.crc)
        self.crc.append(crc)
        if n == len(self.count):
            self.count = np.concatenate([self.count, np.zeros(n, dtype=np.int64)])
            self.gain = np.concatenate([self.gain, np.zeros(n, dtype=np.int64)])
        if self.gains is not None:
            self.gain[n] = self.gains[crc % self.buckets]
        return n

    def walk(self, w: list[bytes]) -> np.ndarray:
        """The nodes of all runs of a document's words."""
        level = list(map(self.first.__getitem__, w))
        out = list(level)
        for depth in range(1, min(self.runs, len(w))):
            level = list(map(self.below.__getitem__, zip(level[:-1], w[depth:], strict=True)))
            out += level
        return np.array(out, dtype=np.int64)

    def add(self, nodes: np.ndarray) -> None:
        n = np.bincount(nodes, minlength=1)
        self.count[: len(n)] += n

    def totals(self) -> np.ndarray:
        at = np.array(self.crc, dtype=np.int64) % self.buckets
        out = np.zeros(self.buckets, dtype=np.int64)
        np.add.at(out, at, self.count[: len(at)])
        return out


def bucket_totals(texts: DataFrame, draw: Draw) -> DataFrame:
    """(bucket, n): features of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, sums = Trie(draw.runs, draw.buckets), np.zeros(draw.buckets, dtype=np.int64)
        for batch in batches:
            for t in batch.column("text"):
                trie.add(trie.walk(words(t.as_py())))
                if len(trie.crc) > NODES:
                    sums += trie.totals()
                    trie = Trie(draw.runs, draw.buckets)
        sums += trie.totals()
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, draw: Draw) -> np.ndarray:
    """The gain of each bucket."""
    spark = docs.sparkSession
    both = bucket_totals(docs, draw).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.union(bucket_totals(target, draw).select("bucket", F.lit(0).cast("long"), F.col("n")))
    both = both.union(spark.range(draw.buckets).select("id", F.lit(0).cast("long"), F.lit(0).cast("long")))
    each = written(both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")))
    all_s, all_t = each.agg(F.sum("s"), F.sum("t")).first()
    m = float(draw.buckets)
    gain = F.floor(draw.scale * F.log((F.col("t") + 1) * F.lit(all_s + m) / ((F.col("s") + 1) * F.lit(all_t + m))))
    out = np.zeros(draw.buckets, dtype=np.int64)
    for r in each.select("bucket", gain.alias("gain")).collect():  # a row for each bucket
        out[r.bucket] = r.gain
    return out


def weighed(docs: DataFrame, gain: np.ndarray, draw: Draw) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(draw.runs, draw.buckets, gain)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for t in batch.column("text"):
                w = words(t.as_py())
                nodes = trie.walk(w)
                n_words.append(len(w)), n_features.append(len(nodes)), weight.append(int(trie.gain[nodes].sum()))
                if len(trie.crc) > NODES:
                    trie = Trie(draw.runs, draw.buckets, gain)
            columns = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(draw: Draw) -> Column:
    """Seeded Gumbel noise of a document, in whole steps."""
    digest = F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-draw.scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, draw: Draw) -> DataFrame:
    """``scored`` (written: row, doc_id, n_words, score, ...) with ``rank``, null for documents that aren't drawn."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    fit = scored.where(F.col("n_words") >= draw.least_words).select("row", "doc_id", "score")
    ranges = written(fit.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy(F.col("part").alias("_part")).agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")
    sizes = written(sizes.select("_part", "_n", ahead.alias("_ahead")))
    quota = draw.percent * (sizes.agg(F.sum("_n")).first()[0] or 0) // 100
    held = ranges.join(small(sizes.where(F.col("_ahead") < quota)), F.col("part") == F.col("_part"))
    rank = (F.col("_ahead") + F.row_number().over(Window.partitionBy("part").orderBy(*order))).alias("rank")
    drawn = held.select(F.col("row").alias("_row"), rank).where(F.col("rank") <= quota)
    return scored.join(drawn, F.col("row") == F.col("_row"), "left").drop("_row")


def resampled(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of ``docs``; both tables have a column ``text``."""
    out = weighed(docs, gains(docs, target, draw), draw)
    out = out.withColumn("score", F.col("weight") + noise(draw)).withColumn("row", F.monotonically_increasing_id())
    return ranked(written(out), draw).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
