"""SimHash fingerprints and links between those that differ in few bits.

1. Fingerprints: one Arrow pass; equal ones are summed up to classes before anything else, so that copies cost a row.
2. Candidates for radius 2: of four bands of 16 bits two are equal. Each class is put under the six masked bit patterns
   of two bands, the upper nodes of the index. A node over ``MOST`` members gets lower nodes: its free bits fall into
   three bands, of which one has to be equal. The classes of a node differ, so that after a few steps no node can be
   larger; nothing is capped.
3. Inside a node, members are sorted by Gray rank and searched with ``gray_index``. A node gives, for each member, its
   link to the smallest member of its component in the node: links are not expanded into pairs.
4. ``components`` joins these links; every document gets the smallest ``doc_id`` of its component.

Cases: a null text counts as empty; texts without words have fingerprint zero and are linked like others. A null
``doc_id`` is never the smallest unless its component has no other. Repeated rows are separate documents of one class.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.components import components
from tessera.llm.gray_index import Index, labels

#: Members of a node that are searched in one piece.
MOST = 4096

SEED = 42


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of a text, repeats included; of the whole sequence if it is shorter."""
    # bytes.lower changes A-Z alone and bytes.split splits at the white space of the contract
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    one = xxhash.xxh64_intdigest
    joined = b" ".join(w)
    if len(w) <= k:
        return np.array([one(joined, SEED)], dtype=np.uint64)
    at, starts = 0, []
    for x in w:
        starts.append(at)
        at += len(x) + 1
    starts.append(at)
    return np.fromiter((one(joined[a : b - 1], SEED) for a, b in zip(starts, starts[k:], strict=False)), dtype=np.uint64, count=len(w) - k + 1)


def majority(h: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``h``."""
    n = len(h)
    if not n:
        return 0
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    # eight counters of a byte in one word; 255 rows can't overflow them
    pad = -n % 255
    if pad:
        bits = np.concatenate([bits, np.zeros((pad, 64), dtype=np.uint8)])
    sums = bits.view(np.uint64).reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
    counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((majority(shingle_hashes(t.as_py(), k)) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bands(free: list[int], n: int) -> list[int]:
    """Masks of ``n`` runs of the given bits, about equal."""
    cuts = [round(i * len(free) / n) for i in range(n + 1)]
    return [sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def first_masks(radius: int = 2) -> list[int]:
    """Masks of all pairs of ``radius + 2`` bands: fingerprints within the radius agree on one of them."""
    bands = _bands(list(range(64)), radius + 2)
    return [a | b for i, a in enumerate(bands) for b in bands[:i]]


def lower_masks(mask: int, radius: int = 2) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | x for x in _bands(free, radius + 1)] if len(free) > radius + 1 else []


def _masked(masks: list[int]) -> Column:
    return F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks)))


def nodes(prints: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """(mask, pattern, print): the members of every masked pattern with two members at least, refined down to ``most``."""
    masks = first_masks(radius)
    members = prints.select("print", _masked(masks).alias("mask"))
    out = None
    while masks:
        members = members.withColumn("pattern", F.col("print").bitwiseAND(F.col("mask")))
        sizes = members.groupBy(F.col("mask").alias("_m"), F.col("pattern").alias("_p")).agg(F.count("*").alias("size")).where("size > 1")
        held = written(members.join(sizes, (F.col("mask") == F.col("_m")) & (F.col("pattern") == F.col("_p"))).select("mask", "pattern", "print", "size"))
        below = {m: lower_masks(m, radius) for m in masks}
        # a mask that leaves too few bits to divide has few members: they differ
        done = held.where((F.col("size") <= most) | F.col("mask").isin([_signed(m) for m, x in below.items() if not x]))
        out = done.drop("size") if out is None else out.unionByName(done.drop("size"))
        over = held.where(F.col("size") > most)
        large = [r.mask for r in over.select("mask").distinct().collect()]
        masks = sorted({x for m in large for x in below[m % (1 << 64)]})
        if masks:
            pairs = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("_of"), F.lit(_signed(x)).cast("long").alias("_mask")) for m in large for x in below[m % (1 << 64)])))
            table_of = F.broadcast(prints.sparkSession.range(1).select(pairs.alias("x")).select("x.*"))
            members = over.join(table_of, F.col("mask") == F.col("_of")).select("print", F.col("_mask").alias("mask")).distinct()
    return out


def gray_order(x: Column) -> Column:
    """A long that sorts like the Gray rank of an unsigned 64-bit number."""
    for by in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, by))
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[list[np.ndarray]]:
    """Columns as numpy arrays, cut between groups (equal first ``keys`` columns), of at least ``least`` rows but the last."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(x[0]) for x in held) < least:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0))
        cut = new[-1] + 1 if len(new) else 0
        if cut:
            yield [c[:cut] for c in cols]
        held = [[c[cut:] for c in cols]]
    if held and len(held[0][0]):
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def links(grouped: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) of signed longs: each member's link to the first of its component inside a node of ``grouped``."""
    order = grouped.repartition("mask", "pattern").withColumn("rank", gray_order(F.col("print"))).sortWithinPartitions("mask", "pattern", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, pattern, prints in _whole_groups(batches, 2, 20_000):
            new = np.r_[False, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])]
            found = Index(prints.view(np.uint64).reshape(-1, 1), np.cumsum(new)).within(radius)
            first = labels(len(prints), found)
            other = np.flatnonzero(first != np.arange(len(prints)))
            yield pa.RecordBatch.from_arrays([pa.array(prints[other]), pa.array(prints[first[other]])], names=["a", "b"])

    return order.select("mask", "pattern", "print").mapInArrow(run, "a long, b long")


def grouped(prints: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """``prints`` (doc_id, print; a written table) with ``component_id``, the smallest doc_id that links reach."""
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    star = components(links(nodes(classes.select("print"), radius, most), radius))
    rooted = classes.join(star, F.col("print") == F.col("a"), "left").select("print", "least", F.coalesce("b", "print").alias("root"))
    lowest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    found = rooted.join(lowest, F.col("root") == F.col("_root")).select(F.col("print").alias("_print"), "component_id")
    return prints.join(found, F.col("print") == F.col("_print")).drop("_print")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(fingerprints(table(spark, sf_dir, "documents")))
    out = grouped(prints)
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
