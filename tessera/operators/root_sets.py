"""Which roots each key of a graph reaches, for all roots at once: sets of bits instead of a row for each root and key.

Roots are numbered. A number's upper bits name a *slot* of 65,536 roots, its lower bits a place in it. A row is a key, a
slot and a set of places: their numbers if they are few, else a bit for each place (8 kB at most). A step along the edges
sends a key's sets to its callers, where sets of one slot are united; what a caller had before is taken out. A set is united as
its rows are read, so that a task holds one slot at a time, however many edges a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.common import saved

PLACES = 1 << 16
#: Places that are kept as numbers: below this they take less room than bits.
FEW = 4096


def packed(places: np.ndarray) -> bytes:
    """Sorted distinct places as bytes."""
    if len(places) < FEW:
        return places.astype("<u2").tobytes()
    bits = np.zeros(PLACES, dtype=np.uint8)
    bits[places] = 1
    return np.packbits(bits).tobytes()


def unpacked(said: bytes) -> np.ndarray:
    if len(said) < 2 * FEW:
        return np.frombuffer(said, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(said, dtype=np.uint8)))


def numbered(roots: DataFrame) -> DataFrame:
    """(key, root): a number for each distinct key; a written table."""
    return saved(roots.select("key").distinct().withColumn("root", F.monotonically_increasing_id()))


def _swept(order: DataFrame, keys: list[str], schema: str, take: Callable, give: Callable) -> DataFrame:
    """Goes over ``order`` (``keys``, kind, bits), sorted: ``take(state, kind, places)`` for each row, ``give(state)`` after each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        now, state, out = None, None, []
        packed_rows = lambda: pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))
        for batch in batches:
            for *key, kind, bits in zip(*(batch.column(c).to_pylist() for c in (*keys, "kind", "bits")), strict=True):
                if key != now:
                    if now is not None:
                        out += [(*now, *x) for x in give(state)]
                    now, state = key, [np.zeros(PLACES, dtype=np.int64), np.zeros(PLACES, dtype=bool)]
                    if len(out) > 4096:
                        yield packed_rows()
                        out = []
                take(state, kind, unpacked(bits))
        if now is not None:
            out += [(*now, *x) for x in give(state)]
        if out:
            yield packed_rows()

    return order.repartition(*keys).sortWithinPartitions(*keys, "kind").select(*keys, "kind", "bits").mapInArrow(run, schema)


def _add(state: list, kind: int, places: np.ndarray) -> None:
    state[kind][places] = 1


def reached(names: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(key, slot, bits, depth): the roots that each key reaches backwards within ``depth`` calls, each at its least depth.

    ``names``: key, root (see ``numbered``). ``edges``: callee, caller. A root reaches itself at 0.
    """
    kind = names.schema["key"].dataType.simpleString()
    steps = saved(edges.select(F.col("callee").alias("_to"), F.col("caller").alias("_from")).distinct())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = batch.column("root").to_numpy()
            bits = pa.array([packed(np.array([r % PLACES])) for r in root], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(root // PLACES), bits], names=["key", "slot", "bits"])

    frontier = saved(names.mapInArrow(first, f"key {kind}, slot long, bits binary").withColumn("depth", F.lit(0)))
    visited = frontier

    def new(state: list) -> list:
        left = np.flatnonzero(state[1] & (state[0] == 0))
        return [(packed(left),)] if len(left) else []

    for k in range(1, depth + 1):
        ahead = frontier.join(steps, F.col("key") == F.col("_to")).select(F.col("_from").alias("key"), "slot", "bits", F.lit(1).alias("kind"))
        # only what a step has reached is held against what was known
        known = visited.join(ahead.select(F.col("key").alias("_k"), F.col("slot").alias("_s")).distinct(), (F.col("key") == F.col("_k")) & (F.col("slot") == F.col("_s")), "left_semi")
        both = ahead.unionByName(known.select("key", "slot", "bits", F.lit(0).alias("kind")))
        frontier = saved(_swept(both, ["key", "slot"], f"key {kind}, slot long, bits binary", _add, new).withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def gathered(met: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, slot, bits): the roots that any of an owner's keys reaches. ``owners``: owner, key."""
    rows = met.join(owners, "key").select("owner", "slot", F.lit(1).alias("kind"), "bits")
    united = lambda state: [(packed(np.flatnonzero(state[1])),)]
    return _swept(rows, ["owner", "slot"], "owner string, slot long, bits binary", _add, united)


def counted(sets: DataFrame) -> DataFrame:
    """(root, n): the sets (slot, bits) that hold each root. Sums are made where the rows are read, a slot at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(PLACES, dtype=np.int64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array(now * PLACES + at), pa.array(sums[at])], names=["root", "n"])

        for batch in batches:
            for slot, bits in zip(batch.column("slot").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                if slot != now:
                    if now is not None:
                        yield done()
                    now, sums = slot, np.zeros(PLACES, dtype=np.int64)
                sums[unpacked(bits)] += 1
        if now is not None:
            yield done()

    # rows of a slot may be in many tasks: their sums are added up
    parts = sets.select("slot", "bits").sortWithinPartitions("slot").mapInArrow(run, "root long, n long")
    return parts.groupBy("root").agg(F.sum("n").alias("n"))


def members(sets: DataFrame) -> DataFrame:
    """(root): the roots that any of the sets (slot, bits) holds."""
    return counted(sets).select("root")
