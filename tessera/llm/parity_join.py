"""Jaccard join of word n-gram sets by parity sketches.

1. Sets: the distinct hashes of a text's shingles. Documents of equal sets are one *class*.
2. Sketches: every shingle flips one bit of a long bit string, so that the Hamming distance of two sketches is at most
   the symmetric difference of their sets. At a similarity of ``LEAST`` (p / q) that is at most (q - p) / (q + p) of the
   two sizes together, called the budget.
3. Pigeonhole: sizes fall into bands, and a pair is looked for in the band of its smaller set (the larger one is at most
   q / p of it, which decides the bands a set is put under). A band has a budget d and cuts the sketch into
   d + 1 + e parts, so that e + 1 of them at least are equal in a pair that links. A part's signature is the XOR of a
   hash of each set bit. The sketch that is cut has 2 ** 64 bits and is never spelled out.
4. Spare parts: a set whose empty parts are at most ``e`` puts none of them down, as another part still is equal. The
   same holds for frequent signatures, of over ``MOST`` classes: a set that has as many as are left of ``e`` leaves them
   all. Sets with more keep them; signatures that stay frequent are searched in blocks. No pair is lost.
5. Classes of a signature are first held against its smallest class by sketches of about 2 bits a shingle. Signatures
   whose classes are then in one component are done; in others all classes of different components are compared.
6. Sets are fetched only for classes with a candidate and compared inside the candidates' components.

Shingles are told by 64-bit hashes, and classes by a 64-bit hash of the set.

Cases: a null text and a text without words have an empty set, which links with nothing (``n_shingles`` 0). A text with
fewer words than a shingle is one shingle. A null ``doc_id`` is never the smallest unless its component has no other.
Repeated rows are separate documents of one class. Columns besides doc_id and text are not looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import forget, small, table, written
from tessera.llm.components import components
from tessera.llm.gray_index import popcount
from tessera.llm.near_duplicates import LEAST, alike, mixed
from tessera.llm.simhash import _whole_groups, shingle_hashes

SHINGLE = 5
#: Classes that are searched in one piece; also the classes from which a signature is frequent.
MOST = 4096
#: Classes that a task remembers so as not to put copies down again.
SEEN = 1 << 18


def budget(a: int, b: int) -> int:
    """The largest symmetric difference of sets of these sizes that link."""
    p, q = LEAST
    return (a + b) * (q - p) // (q + p)


@lru_cache(maxsize=1)
def band_starts() -> np.ndarray:
    p, q = LEAST
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, (out[-1] - 1) * q // p + 1))
    return np.array(out, dtype=np.int64)


@lru_cache(maxsize=512)
def parts_of(band: int) -> tuple[int, int]:
    """(budget d, spare parts e) of a band; it has d + 1 + e parts. A budget of 0 needs none: such sets are equal."""
    p, q = LEAST
    low, most = int(band_starts()[band]), int(band_starts()[band + 1]) - 1
    d = budget(most, most * q // p)
    e = 0
    for _ in range(20):
        k = d + 1 + e
        empty = k * np.exp(-low / k)
        e = int(np.ceil(empty + 2.5 * np.sqrt(empty) + 0.05 * k))
    return d, min(e, d + 2)


@lru_cache(maxsize=64)
def edges_of(k: int) -> np.ndarray:
    """Where each of ``k`` equal ranges of the 64-bit numbers starts."""
    return np.array([-(-(j << 64) // k) for j in range(k)], dtype=np.uint64)


def bands_of(n: int) -> range:
    """The bands of the smaller set in a pair with a set of ``n`` as the larger, or with one as the smaller."""
    p, q = LEAST
    low = -(-n * p // q)
    at = np.searchsorted(band_starts(), [low, n], side="right") - 1
    return range(int(at[0]), int(at[1]) + 1)


def cut(h: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """First shingle of each part of a set (sorted hashes) that isn't empty, and the part's number."""
    d, e = parts_of(band)
    starts = np.searchsorted(h, edges_of(d + 1 + e))
    full = np.flatnonzero(np.diff(np.r_[starts, len(h)]))
    return starts[full], full


def spares(h: np.ndarray) -> tuple[list[int], list[int]]:
    """Bands of a set and how many parts it may leave out in each, below 0 if it can't spare its empty ones."""
    bands, left = [], []
    for band in bands_of(len(h)):
        d, e = parts_of(band)
        if d:
            bands.append(band)
            left.append(e - (d + 1 + e - len(cut(h, band)[1])))
    return bands, left


def signatures(h: np.ndarray) -> np.ndarray:
    """Signatures of the parts of a set in all its bands; the upper eight bits are the band."""
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    bits, out = mixed(h, 12), []
    for band in bands_of(len(h)):
        d, e = parts_of(band)
        if not d:
            continue
        starts, full = cut(h, band)
        digest = np.bitwise_xor.reduceat(bits, starts)
        if d + 1 + e - len(full) > e:
            void = np.setdiff1d(np.arange(d + 1 + e), full)
            full, digest = np.r_[full, void], np.r_[digest, np.zeros(len(void), dtype=np.uint64)]
        sig = mixed(digest ^ mixed(full.astype(np.uint64), 14), 13)
        out.append(sig >> np.uint64(8) | np.uint64(band << 56))
    return np.concatenate([np.zeros(0, dtype=np.uint64), *out])


def sketch(h: np.ndarray) -> bytes:
    """Parity bits: as many as the power of two from twice the shingles on, 64 at least."""
    m = 1 << max(6, (2 * len(h) - 1).bit_length() if len(h) else 6)
    bits = np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(x: int, size: int, to: int) -> int:
    """A sketch of ``size`` bits as one of ``to`` bits: the upper half goes onto the lower."""
    while size > to:
        size //= 2
        x = x >> size ^ x & ((1 << size) - 1)
    return x


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance at the length of the shorter sketch: at most the symmetric difference of the sets."""
    to = 8 * min(len(a), len(b))
    return (folded(int.from_bytes(a, "little"), 8 * len(a), to) ^ folded(int.from_bytes(b, "little"), 8 * len(b), to)).bit_count()


def shingles(text: str | None, k: int) -> tuple[np.ndarray, int]:
    """Sorted distinct hashes of a text's shingles, and their digest."""
    h = np.unique(shingle_hashes(text, k))
    return h, xxhash.xxh64_intdigest(h.tobytes(), 7)


def _longs(x) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def sized(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, key, node, n, sketch, bands, spare): ``key`` tells texts apart, ``node`` classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, bands, left = [], [], [], [], []
            for t in batch.column("text"):
                h, node = shingles(t.as_py(), k)
                b, s = spares(h) if len(h) else ([], [])
                nodes.append(node), sizes.append(len(h)), prints.append(sketch(h)), bands.append(b), left.append(s)
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), _longs(nodes), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, lists), pa.array(left, lists)],
                names=["doc_id", "key", "node", "n", "sketch", "bands", "spare"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, node long, n long, sketch binary, bands array<int>, spare array<int>")


def signed(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(sig, node): the signatures of each text; a task leaves out classes that it has just put down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs, nodes, held = [], [], 0
            for t in batch.column("text"):
                h, node = shingles(t.as_py(), k)
                if node in seen:
                    continue
                seen.add(node)
                if len(seen) > SEEN:
                    seen.clear()
                sigs.append(signatures(h))
                nodes.append(np.full(len(sigs[-1]), node, dtype=np.uint64))
                held += len(sigs[-1])
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([_longs(np.concatenate(sigs)), _longs(np.concatenate(nodes))], names=["sig", "node"])
                    sigs, nodes, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(sigs)), _longs(np.concatenate(nodes))], names=["sig", "node"])

    return docs.select("text").mapInArrow(run, "sig long, node long")


def shared(sigs: DataFrame) -> DataFrame:
    """Distinct (sig, node) of signatures with two classes at least: one exchange; a task holds a batch and one row."""
    order = sigs.repartition("sig").sortWithinPartitions("sig", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig, last_node, paired = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.concatenate([last_sig, batch.column("sig").to_numpy()])
            node = np.concatenate([last_node, batch.column("node").to_numpy()])
            new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
            sig, node = sig[new], node[new]
            same = sig[1:] == sig[:-1]
            out = np.r_[paired, same] | np.r_[same, False]
            paired = bool(out[-1])
            last_sig, last_node = sig[-1:], node[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(sig[:-1][out[:-1]]), pa.array(node[:-1][out[:-1]])], names=["sig", "node"])
        if paired:
            yield pa.RecordBatch.from_arrays([pa.array(last_sig), pa.array(last_node)], names=["sig", "node"])

    return order.mapInArrow(run, "sig long, node long")


def without_spared(members: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """``members`` (sig, node) without frequent signatures of classes that can spare all of theirs in a band."""
    hot = written(members.groupBy(F.col("sig").alias("_sig")).agg(F.count("*").alias("size")).where(F.col("size") > most).select("_sig"))
    if hot.isEmpty():
        return members
    frequent = written(members.join(small(hot), F.col("sig") == F.col("_sig")).select("sig", "node", F.shiftrightunsigned("sig", 56).cast("int").alias("band")))
    many = frequent.groupBy(F.col("node").alias("_node"), F.col("band").alias("_band")).agg(F.count("*").alias("many"))
    each = classes.select("node", F.explode(F.arrays_zip("bands", "spare")).alias("x")).select("node", "x.bands", "x.spare")
    spared = many.join(each, (F.col("_node") == F.col("node")) & (F.col("_band") == F.col("bands"))).where("many <= spare").select("_node", "_band")
    left = frequent.join(spared, (F.col("node") == F.col("_node")) & (F.col("band") == F.col("_band")), "left_anti").select("sig", "node")
    return written(members.join(small(hot), F.col("sig") == F.col("_sig"), "left_anti").union(left))


def near_first(stars: DataFrame, classes: DataFrame) -> DataFrame:
    """Those (a, b) of ``stars`` whose sketches are within the budget."""
    side = lambda x: classes.select(F.col("node").alias(f"_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = stars.join(small(side("a")), F.col("a") == F.col("_a")).join(small(side("b")), F.col("b") == F.col("_b"))
    p, q = LEAST
    both = both.where(F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), batch.column("s_a"), batch.column("s_b"), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([distance(s.as_py(), t.as_py()) <= budget(m, n) for m, n, s, t in sizes], pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def across(n: np.ndarray, prints: list[bytes], label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs within the budget that join members of different labels, as few as are needed to join them."""
    to = min(map(len, prints))
    rows = np.array([np.frombuffer(folded(int.from_bytes(x, "little"), 8 * len(x), 8 * to).to_bytes(to, "little"), dtype=np.uint64) for x in prints])
    p, q = LEAST
    label, out = label.copy(), []
    for i in range(len(n) - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        lo, hi = np.minimum(n[other], n[i]), np.maximum(n[other], n[i])
        other = other[lo * q >= hi * p]
        other = other[popcount(rows[other] ^ rows[i]) * (q + p) <= (n[other] + n[i]) * (q - p)]
        for j in other:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, int(j)))
    return out


def blocks(members: DataFrame, most: int, *by: str) -> DataFrame:
    """``members`` (node, size of the group ``by``, ...) with ``block``: any two of a group meet in one."""
    k = F.when(F.col("size") > most, F.ceil(F.col("size") / max(1, most // 2))).otherwise(1).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit(2)), k)
    dealt = members.select("*", k.alias("_k"), own.alias("_own")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    dealt = dealt.where("_k = 1 or _own <> _other").withColumn("block", F.least("_own", "_other") * F.col("_k") + F.greatest("_own", "_other"))
    return dealt.drop("_k", "_own", "_other")


def second_links(open_groups: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(a, b) between classes of ``open_groups`` (sig, node, label, size) within the budget."""
    said = small(classes.select(F.col("node").alias("_node"), "n", "sketch"))
    dealt = blocks(open_groups, most, "sig").join(said, F.col("node") == F.col("_node"))
    order = dealt.select("sig", "block", "node", "label", "n", "sketch").repartition("sig", "block").sortWithinPartitions("sig", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, block, node, label, n, prints in _whole_groups(batches, 2, 4096):
            starts = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (block[1:] != block[:-1])])
            found = [(lo + i, lo + j) for lo, hi in zip(starts, np.r_[starts[1:], len(node)], strict=True) for i, j in across(n[lo:hi], list(prints[lo:hi]), label[lo:hi])]
            a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return order.mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame, members: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): the components of pairs within the budget, each node with the smallest; holds all pairs that link."""
    members = without_spared(members, classes, most)
    # parts of a group of near copies give equal groups: one of each is enough
    prints = (F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    groups = members.groupBy("sig").agg(F.count("*").alias("size"), F.min("node").alias("lo"), *prints).where("size > 1")
    one = groups.groupBy("size", "x", "y").agg(F.min("sig").alias("_sig"), F.min("lo").alias("lo"))
    held = written(members.join(small(written(one.select("_sig", "lo", "size"))), F.col("sig") == F.col("_sig")).select("sig", "node", "lo", "size"))
    first = written(near_first(held.where("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct(), classes))
    star = small(components(first).select(F.col("a").alias("_a"), F.col("b").alias("_b")))
    labelled = held.join(star, F.col("node") == F.col("_a"), "left").select("sig", "node", "size", F.coalesce("_b", "node").alias("label"))
    is_open = labelled.groupBy(F.col("sig").alias("_sig")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("_sig")
    left = written(labelled.join(small(written(is_open)), F.col("sig") == F.col("_sig")).select("sig", "node", "label", "size"))
    return components(first.union(written(second_links(left, classes, most))))


def sets_of(docs: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(node, root, size, set) for the texts of ``wanted`` (key, root, size); a class may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for t, root, size in zip(batch.column("text"), batch.column("root").to_pylist(), batch.column("size").to_pylist(), strict=True):
                h, node = shingles(t.as_py(), k)
                if node not in seen:
                    rows.append((node, root, size, h.tobytes()))
                    seen.add(node)
                    if len(seen) > SEEN:
                        seen.clear()
            node, root, size, sets = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([_longs(node), pa.array(root, pa.int64()), pa.array(size, pa.int64()), pa.array(sets, pa.binary())], names=["node", "root", "size", "set"])

    said = small(wanted.select(F.col("key").alias("_key"), "root", "size"))
    rows = docs.select("text", F.xxhash64("text").alias("key")).join(said, F.col("key") == F.col("_key"))
    return rows.select("text", "root", "size").mapInArrow(run, "node long, root long, size long, set binary")


def against_first(sets: DataFrame, most: int) -> DataFrame:
    """Members of components over ``most`` with ``linked``: whether they link with the component's smallest class."""
    lead = sets.where("node = root").select(F.col("root").alias("_root"), F.col("set").alias("lead")).dropDuplicates(["_root"])
    both = sets.join(small(written(lead)), F.col("root") == F.col("_root")).select("node", "root", "set", "lead")
    p, q = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for s, t in zip(batch.column("set"), batch.column("lead"), strict=True):
                a, b = np.frombuffer(s.as_py(), dtype=np.uint64), np.frombuffer(t.as_py(), dtype=np.uint64)
                n = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(n * q >= (len(a) + len(b) - n) * p)
            yield batch.select(["node", "root", "set"]).append_column("linked", pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "node long, root long, set binary, linked boolean")


def verified(sets: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links by the sets of ``sets`` (node, root, size, set) inside each root; not all of them, but what joins them.

    A component over ``most`` is held against its smallest class first. What links with that needs no comparison with
    its like; what doesn't meets all others in blocks.
    """
    plain = sets.where(F.col("size") <= most).select("root", F.lit(0).cast("long").alias("block"), "node", "set")
    large, links = sets.where(F.col("size") > most), None
    if not large.select("root").isEmpty():
        large = written(against_first(written(large.dropDuplicates(["root", "node"])), most))
        links = large.where("linked and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        many = written(large.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("apart")).where("apart > 0"))
        half = max(1, most // 2)
        dealt = large.join(small(many), F.col("root") == F.col("_root"))
        dealt = dealt.withColumns({"rows": F.ceil(F.col("n") / half).cast("long"), "cols": F.ceil(F.col("apart") / half).cast("long")})
        own = lambda k: F.pmod(F.xxhash64("node", F.lit(2)), F.col(k))
        every = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
        at = F.transform(every("cols"), lambda c: own("rows") * F.col("cols") + c)
        also = F.when(~F.col("linked"), F.transform(every("rows"), lambda r: r * F.col("cols") + own("cols"))).otherwise(F.array().cast("array<bigint>"))
        plain = plain.union(dealt.select("root", F.explode(F.array_union(at, also)).alias("block"), "node", "set"))
    order = plain.repartition("root", "block").sortWithinPartitions("root", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root, block, node, sets in _whole_groups(batches, 2, 512):
            new = np.r_[True, (root[1:] != root[:-1]) | (block[1:] != block[:-1]) | (node[1:] != node[:-1])]
            root, block, node, sets = root[new], block[new], node[new], sets[new]
            starts = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (block[1:] != block[:-1])])
            for lo, hi in zip(starts, np.r_[starts[1:], len(node)], strict=True):
                all_sets = [np.frombuffer(x, dtype=np.uint64) for x in sets[lo:hi]]
                first = lo + alike(np.zeros((hi - lo, 1), dtype=np.uint64), all_sets)
                other = np.flatnonzero(first != np.arange(lo, hi)) + lo
                if len(other):
                    yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[first[other - lo]])], names=["a", "b"])

    found = order.mapInArrow(run, "a long, b long")
    return found if links is None else found.union(links)


def joined(docs: DataFrame, k: int = SHINGLE, most: int = MOST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    rows = written(sized(docs, k))
    classes = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("n", "sketch", "bands", "spare"))))
    members = written(shared(signed(docs, k)))
    near = components_of(candidates(classes, members, most))
    forget(members)
    wanted = written(classes.select("node", "key").join(small(near), F.col("node") == F.col("_node")).select("key", "root", "size"))
    star = components(written(verified(sets_of(docs, wanted, k), most)))
    rooted = classes.join(small(star), F.col("node") == F.col("a"), "left").select("node", "n", "least", F.coalesce("b", "node").alias("root"))
    lowest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    found = small(written(rooted.where("n > 0").join(lowest, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "component_id")))
    out = rows.select("doc_id", "node", F.col("n").alias("n_shingles")).join(found, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def components_of(star: DataFrame) -> DataFrame:
    """Written (_node, root, size): every member of the components of ``star`` (a, b), the smallest included."""
    both = star.select(F.col("a").alias("_node"), F.col("b").alias("root")).union(star.select("b", "b").distinct())
    sizes = both.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("size"))
    return written(both.join(sizes, F.col("root") == F.col("_root")).select("_node", "root", "size"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))
