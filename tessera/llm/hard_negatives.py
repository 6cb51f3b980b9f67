"""Hard negatives by branch and bound over ball trees.

1. Vectors become whole numbers, so that scores (inner products) are exact and ties are real.
2. Anchors fall into blocks of about ``BLOCK``, rows into groups; a *cell* is a block and a group. A task reads a cell's
   anchors, then streams its rows in chunks of ``CHUNK``, builds a ball tree for each and searches it for all
   anchors at once (``ball_tree``). What an anchor has found so far bounds the later chunks. Memory is that of a block and a chunk.
3. The first pass takes each anchor's best rows of its own label, its positives. The second looks for rows of other
   labels inside the score window of each positive. What the groups give for an anchor is ranked and cut; there are
   ``positives * negatives`` rows at most for each anchor and group.

The number of groups falls as that of the blocks grows, so that cells are as many as tasks are wanted, or hold
``GROUP`` rows. A label or an id may hold any part of the rows: neither decides where a row goes.

Cases: rows with a null label, a null vector, or a null, NaN or infinite component take no part. A null ``vec_id`` is no
anchor and comes last among equal scores. Repeated rows are separate rows, and an anchor is only left out against
itself; a repeated anchor gives its results twice. Shorter vectors count as ended by zeros. An anchor without positives,
and a positive without a row in its window, gives no rows. Other columns are not looked at. Components are taken up to
2 ** 31; scores that no long can hold wrap around. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.ball_tree import Best
from tessera.llm.common import small, table, written

#: Anchors of a block, rows of a tree (the first one of a cell is smaller) and rows of a group.
BLOCK, CHUNK, FIRST, GROUP = 2048, 8192, 512, 4_000_000
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Mining:
    anchors: int = 100
    relabel: int = 7
    labels: int = 10
    scale: int = 256
    positives: int = 5
    negatives: int = 10
    #: Ends of a window, as hundredths of the positive's score.
    window: tuple[int, int] = (30, 90)


def whole(rows: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(row, vec_id, label, vec) of the rows that take part; a written table."""
    limit = float(1 << 31)
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    step = lambda x: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), mining.scale * x.cast("double")))).cast("long")
    label = F.col("label").cast("long")
    said = F.when(F.col("vec_id") % mining.relabel == 0, (label + 1) % mining.labels).otherwise(label)
    held = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", sound))
    out = held.select(F.col("vec_id").cast("long").alias("vec_id"), said.alias("label"), F.transform("embedding", step).alias("vec"))
    return written(out.withColumn("row", F.monotonically_increasing_id()))


def dealt(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """Anchors (kind 0) and rows (kind 1) by cell, in the order in which a task reads them."""
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_anchors // BLOCK))
    groups = max(-(-tasks // blocks), -(-n_rows // GROUP))
    nth = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    spread = lambda seed, k: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(k)).cast("int")
    first = anchors.withColumn("_g", F.explode(nth(groups))).withColumn("cell", spread(1, blocks) * groups + F.col("_g")).withColumn("kind", F.lit(0))
    then = rows.withColumn("_b", F.explode(nth(blocks))).withColumn("cell", F.col("_b") * groups + spread(2, groups)).withColumn("kind", F.lit(1))
    then = then.withColumns({"low": F.array().cast("array<bigint>"), "high": F.array().cast("array<bigint>")})
    columns = ["cell", "kind", "row", "vec_id", "label", "vec", "low", "high"]
    both = first.select(*columns).union(then.select(*columns)).withColumn("vec_id", F.coalesce("vec_id", F.lit(LAST)))
    return both.repartitionByRange(blocks * groups, "cell").sortWithinPartitions("cell", "kind", "label", "row")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of whole numbers, ended by zeros where they are shorter than the longest."""
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), n.max(initial=0)), dtype=np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
    return out


def _as_wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _windows(lists: pa.Array, fill: int) -> np.ndarray:
    n = np.diff(lists.offsets.to_numpy())
    out = np.full((len(n), n.max(initial=0)), fill, dtype=np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
    return out


class Cell:
    """A cell as a task reads it: anchors first, then rows in chunks."""

    def __init__(self, same: bool, k: int):
        self.same, self.k, self.best, self.seen = same, k, None, 0
        self.anchors: list[pa.RecordBatch] = []
        self.held: list[pa.RecordBatch] = []

    def _begin(self) -> None:
        t = pa.Table.from_batches(self.anchors).combine_chunks().to_batches()[0]
        column = lambda c: t.column(c).to_numpy()
        # a window that an anchor lacks can't hold anything
        low, high = _windows(t.column("low"), 1), _windows(t.column("high"), 0)
        self.row, self.q = column("row"), _matrix(t.column("vec"))
        self.best = Best(self.q, column("label"), self.row, self.same, low, high, self.k)

    def read(self, batch: pa.RecordBatch) -> None:
        kind = batch.column("kind").to_numpy()
        n = int((kind == 0).sum())
        if n:
            self.anchors.append(batch.slice(0, n))
        if n < batch.num_rows and self.anchors:
            self.held.append(batch.slice(n))
            held = sum(b.num_rows for b in self.held)
            while held >= (want := FIRST if not self.seen else CHUNK):
                held -= self.look(want)

    def look(self, want: int) -> int:
        t = pa.Table.from_batches(self.held)
        now, self.held = t.slice(0, want).combine_chunks().to_batches(), t.slice(want).to_batches()
        if self.best is None:
            self._begin()
        for b in now:
            x = _matrix(b.column("vec"))
            width = max(x.shape[1], self.q.shape[1])
            if width > self.q.shape[1]:
                self.q = _as_wide(self.q, width)
                self.best.q = self.q.astype(np.float64)
            self.best.look(_as_wide(x, width), b.column("label").to_numpy(), b.column("vec_id").to_numpy(), b.column("row").to_numpy())
            self.seen += b.num_rows
        return want

    def result(self) -> pa.RecordBatch | None:
        while self.held:
            self.look(CHUNK)
            self.held = [b for b in self.held if b.num_rows]
        if self.best is None:
            return None
        found = np.concatenate(self.best.found)
        place = np.repeat(np.arange(len(self.best.found)), [len(f) for f in self.best.found])
        return pa.RecordBatch.from_arrays([pa.array(self.row[found[:, 0]]), pa.array(place), pa.array(found[:, 1]), pa.array(found[:, 2]), pa.array(found[:, 3])], names=["anchor", "place", "score", "id", "row"])


def best(order: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, place, score, id, row): the best of each cell of ``order``, and of them the best of all, with ``rank``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, now = None, None
        for batch in batches:
            number = batch.column("cell").to_numpy()
            starts = np.r_[0, np.flatnonzero(number[1:] != number[:-1]) + 1] if len(number) else []
            for lo, hi in zip(starts, np.r_[starts[1:], len(number)].astype(np.int64), strict=True):
                if number[lo] != now:
                    if cell and (out := cell.result()):
                        yield out
                    cell, now = Cell(same, k), number[lo]
                cell.read(batch.slice(int(lo), int(hi - lo)))
        if cell and (out := cell.result()):
            yield out

    found = order.mapInArrow(run, "anchor long, place long, score long, id long, row long")
    nth = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id", "row"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def _ends(score: Column, part: int, up: bool) -> Column:
    """``part`` hundredths of a score, up or down to a whole number, without doubles."""
    hundred = F.lit(100).cast("long")
    rest = F.pmod(score * part, hundred)
    down = F.call_function("div", score * part - rest, hundred)
    return F.when(rest == 0, down).otherwise(down + int(up))


def mined(rows: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (vec_id, label, embedding)."""
    held = whole(rows, mining)
    anchors = held.where(F.col("vec_id") % mining.anchors == 0)
    n_rows, n_anchors = held.count(), anchors.count()
    ends = {"low": F.array(F.lit(-LAST)), "high": F.array(F.lit(LAST))}
    positive = best(dealt(anchors.withColumns(ends), held, n_anchors, n_rows), True, mining.positives)
    positive = written(positive.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    score, (low, high) = F.col("positive_score"), mining.window
    windows = positive.select("anchor", F.struct("place", _ends(score, low, True).alias("low"), _ends(score, high, False).alias("high")).alias("w"))
    windows = windows.groupBy(F.col("anchor").alias("_row")).agg(F.array_sort(F.collect_list("w")).alias("w"))  # as many as positives
    with_windows = anchors.join(small(written(windows)), F.col("row") == F.col("_row")).withColumns({"low": F.col("w.low"), "high": F.col("w.high")})
    negative = best(dealt(with_windows, held, n_anchors, n_rows), False, mining.negatives)
    negative = negative.select(F.col("anchor").alias("_anchor"), (F.col("place") + 1).alias("_place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positive.join(negative, (F.col("anchor") == F.col("_anchor")) & (F.col("place") == F.col("_place")))
    out = out.join(anchors.select(F.col("row").alias("_row"), F.col("vec_id").alias("anchor_id")), F.col("anchor") == F.col("_row"))
    real = lambda c: F.nullif(F.col(c), F.lit(LAST)).alias(c)
    return out.select("anchor_id", real("positive_id"), F.col("rank").cast("int").alias("rank"), real("negative_id"), "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))
