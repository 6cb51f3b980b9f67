"""Groups of near-duplicate documents by SimHash: five-word shingles, similarity 0.8.

A similarity that low leaves 64-bit fingerprints too far apart for shared bands, so the fingerprint is longer and the
way to candidates differs from ``simhash``; the index and the union of links are the same.

1. One Arrow pass gives each document its shingle set's hashes and digest, a fingerprint of 256 bits and *routes*: the
   set falls into parts by the low bits of its hashes, of 2.2 to 4.5 shingles each, and the digests of twenty parts are
   its routes. Of a pair of similarity 0.8 a part of five is equal with a chance of 0.37, so that all twenty differ with
   a chance of 0.0001; at worst, for sets of about 72, which have sixteen parts in common, with one of 0.002. Sets of neighbouring size classes have a level in
   common, as each is given routes at its own level and the one below.
2. Documents with equal sets become a class before anything is compared.
3. The classes of a route are sorted in Gray order and searched with ``gray_index`` for fingerprints within ``RADIUS``
   bits: at similarity 0.8 the expected distance is 256 * acos(8 / 9) / pi = 39 bits, and over 60 has a chance of 0.0002.
4. A route with over ``MOST`` classes is cut into blocks of about half of that, and every pair of blocks is searched
   together: all classes of a route meet, however many there are.
5. The components of these candidates are only where links may be. In each, sets are compared and those of Jaccard
   similarity ``LEAST`` are linked; a large one is cut into pairs of blocks as routes are.

Cases: a null text counts as empty. Texts without words form one class. Rows that are equal in every way fall into one
class, too. A null ``doc_id`` is the last to be kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import forget, packed, small, written
from tessera.llm.components import components
from tessera.llm.gray_index import Index, labels, popcount
from tessera.llm.simhash import _whole_groups, gray_order, majority, shingle_hashes

SHINGLE = 5
WORDS, RADIUS = 4, 60
#: Similarity of linked documents, as a fraction.
LEAST = (4, 5)
#: Parts of a level that give routes, shingles in a part (about), and classes of a route that are searched in one piece.
PARTS, IN_PART, MOST = 20, 3, 4096


def mixed(h: np.ndarray, by: int) -> np.ndarray:
    """A well-mixed function of 64-bit hashes for each number ``by``."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * (by + 1) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def routes(h: np.ndarray) -> np.ndarray:
    """Digests of the first parts of a set of hashes at its level and the one below."""
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    m, own = mixed(h, 11), mixed(h, 12)
    level = max(4, int(np.log2(max(1, len(h) / (0.75 * IN_PART)))))
    out = []
    for c in (level, level - 1):
        part = (m & np.uint64((1 << c) - 1)).astype(np.int64)
        near = part < PARTS
        digest = np.zeros(PARTS, dtype=np.uint64)
        np.bitwise_xor.at(digest, part[near], own[near])
        held = np.flatnonzero(digest)
        out.append(mixed(digest[held] + (held * 64 + c).astype(np.uint64), 13))
    return np.concatenate(out)


def sketches(docs: DataFrame) -> DataFrame:
    """(row, node, f0..f3, routes, shingles) for ``docs`` (row, text); ``node`` is the digest of the shingle set."""
    row_type = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, lists, sets = [], [], [], []
            for t in batch.column("text"):
                h = np.unique(shingle_hashes(t.as_py(), SHINGLE))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                prints.append([majority(mixed(h, i)) for i in range(WORDS)])
                lists.append(routes(h))
                sets.append(h.tobytes())
            columns = np.array(prints, dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
            ends = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *lists]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(columns[:, i])) for i in range(WORDS)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sets, pa.binary())],
                names=["row", "node", *(f"f{i}" for i in range(WORDS)), "routes", "shingles"],
            )

    return docs.select("row", "text").mapInArrow(run, f"row {row_type}, node long, {', '.join(f'f{i} long' for i in range(WORDS))}, routes array<long>, shingles binary")


def cells(members: DataFrame, most: int) -> DataFrame:
    """``members`` (node, size of its group, ...) with ``block``: any two of a group share one, of about ``most`` at most."""
    k = F.when(F.col("size") > most, F.ceil(F.col("size") / max(1, most // 2))).otherwise(1).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit(2)), k)
    dealt = members.select("*", k.alias("_k"), own.alias("_own")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    dealt = dealt.where("_k = 1 or _own <> _other").withColumn("block", F.least("_own", "_other") * F.col("_k") + F.greatest("_own", "_other"))
    return dealt.drop("_k", "_own", "_other")


def links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links between classes (node, f0..f3, routes) that share a route and lie within the radius."""
    prints = [f"f{i}" for i in range(WORDS)]
    members = classes.select("node", *prints, F.explode("routes").alias("route"))
    sizes = classes.select(F.explode("routes").alias("_route")).groupBy("_route").agg(F.count("*").alias("size")).where("size > 1")
    held = members.join(sizes, F.col("route") == F.col("_route")).drop("_route")
    held = cells(held, most)
    order = held.withColumn("rank", gray_order(F.col("f0"))).repartition("route", "block").sortWithinPartitions("route", "block", "rank", *prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for route, block, node, *f in _whole_groups(batches, 2, 20_000):
            new = np.r_[False, (route[1:] != route[:-1]) | (block[1:] != block[:-1])]
            found = Index(np.stack(f, axis=1).view(np.uint64), np.cumsum(new)).within(RADIUS)
            first = labels(len(node), found)
            other = np.flatnonzero(first != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[first[other]])], names=["a", "b"])

    return order.select("route", "block", "node", *prints).mapInArrow(run, "a long, b long")


def alike(prints: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first of its component, where those of similarity ``LEAST`` within the radius are linked."""
    first = np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    while len(left):
        root, left = left[0], left[1:]
        ahead = [root]
        # what has been reached needs no second link: each set met is held against the ones left
        while ahead and len(left):
            i = ahead.pop()
            lo, hi = np.minimum(size[left], size[i]), np.maximum(size[left], size[i])
            near = np.flatnonzero((lo * LEAST[1] >= hi * LEAST[0]) & (popcount(prints[left] ^ prints[i]) <= RADIUS))
            if not len(near):
                continue
            reached = []
            for at in range(0, len(near), 256):
                some = near[at : at + 256]
                n = size[left[some]]
                flat = np.concatenate([sets[k] for k in left[some]])
                place = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
                both = np.bincount(np.repeat(np.arange(len(some)), n), weights=sets[i][place] == flat, minlength=len(some)).astype(np.int64)
                reached.append(some[both * LEAST[1] >= (n + size[i] - both) * LEAST[0]])
            reached = np.concatenate(reached)
            first[left[reached]] = root
            ahead.extend(left[reached])
            left = np.delete(left, reached)
    return first


def confirmed(sketched: DataFrame, star: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links by the similarity of shingle sets inside the components ``star`` of candidates."""
    prints = [f"f{i}" for i in range(WORDS)]
    group = written(star.select("a", "b").union(star.select(F.col("b").alias("a"), "b").distinct()))
    members = sketched.select("node", *prints, "shingles").join(small(group), F.col("node") == F.col("a"))
    members = members.groupBy("node").agg(*(F.first(c).alias(c) for c in ("b", *prints, "shingles")))
    sizes = group.groupBy(F.col("b").alias("_group")).agg(F.count("*").alias("size"))
    dealt = cells(members.join(small(written(sizes)), F.col("b") == F.col("_group")), most)
    order = dealt.select("b", "block", "node", *prints, "shingles").repartition("b", "block").sortWithinPartitions("b", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, block, node, *f, shingles in _whole_groups(batches, 2, 1):
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (block[1:] != block[:-1])])
            all_prints = np.stack(f, axis=1).view(np.uint64)
            for lo, hi in zip(starts, np.r_[starts[1:], len(node)], strict=True):
                first = lo + alike(all_prints[lo:hi], [np.frombuffer(x, dtype=np.uint64) for x in shingles[lo:hi]])
                other = np.flatnonzero(first != np.arange(lo, hi)) + lo
                if len(other):
                    yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[first[other - lo]])], names=["a", "b"])

    return order.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(row, root) for ``docs`` (row, text): ``root`` is equal for the documents of one group."""
    sketched = written(sketches(docs))
    prints = [f"f{i}" for i in range(WORDS)]
    classes = written(sketched.groupBy("node").agg(*(F.first(c).alias(c) for c in (*prints, "routes"))))
    near = components(written(links(classes, most)))
    star = components(written(confirmed(sketched, near, most)))
    slim = written(sketched.select("row", "node"))
    forget(sketched, classes)
    return slim.join(star, F.col("node") == F.col("a"), "left").select("row", F.coalesce("b", "node").alias("root"))


def kept(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``docs`` without all but one document of each group: that with the smallest doc_id (then key; null comes last).

    Of rows with one id and one text that with the smallest hash of all columns is kept.
    """
    key = F.xxhash64("doc_id", "text")
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), key.alias("key"))
    best = grouped(docs.select(row.alias("row"), "text"), most).groupBy("root").agg(F.min("row").alias("row"))
    best = best.select(F.col("row.id").alias("_id"), F.col("row.key").alias("_key"))
    rows = docs.select(packed(docs).alias("_row"), F.col("doc_id").alias("_doc"), key.alias("_hash"))
    near = rows.join(best, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key"))).select("_row", "_hash")
    # rows with one id and text are in one group, but both are the best of it
    twice = best_twice(docs, key)
    if twice is None:
        return near.select("_row.*")
    alike = near.join(twice, F.col("_hash") == F.col("_twice"), "left_semi").groupBy("_hash").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return near.join(twice, F.col("_hash") == F.col("_twice"), "left_anti").select("_row.*").union(alike.select("_row.*"))


def best_twice(docs: DataFrame, key) -> DataFrame | None:
    """Keys that several rows have, or None where there are none, as is usual."""
    twice = written(docs.groupBy(key.alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1").select("_twice"))
    return None if twice.isEmpty() else twice


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept(docs)
