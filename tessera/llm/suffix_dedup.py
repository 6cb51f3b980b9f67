"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts elsewhere, in any document. With ``keep_first``
the earliest occurrence stays (by doc_id, then position); without, all of them go. Shorter passages, covered by repeated
strings of ``LEAST`` bytes, are told but stay.

1. Anchors: every string of ``LEAST`` bytes names the smallest hash among its ``GRAM``-byte substrings (the last one on
   ties). Equal strings name equal anchors at equal places. Strings that start one after another name the same anchor,
   so that a document gives a record for about 100 bytes: anchor, digest of its *context* (the bytes under all its strings,
   each taken to ``LENGTH`` bytes or the text's end), place. Records are written; the texts do not move.
2. Periodic stretches, whose anchors would change with every period, give the records of one period and of the stretch's
   end. The rest is a range that repeats itself, by comparison of its bytes.
3. Anchors that occur once are dropped. Equal contexts are collapsed into one with a count: all their strings repeat.
4. Where an anchor has several contexts, the first occurrence of each is cut from its text, and the strings of an
   anchor's contexts are put in suffix order (of their own bytes, ties by place). Factors: a string has its longest
   match among all earlier ones with the nearest smaller place before it in that order, or the nearest one after it; the
   match is as long as the least common prefix of neighbours between the two. In the same way the nearest larger places
   give the longest match with a later one. A string repeats where such a factor has ``LENGTH`` bytes.
5. An anchor with over ``MOST`` contexts (a passage of very many documents, with as many surroundings) is refined, once
   for each length: contexts are cut into pieces of ``BLOCK`` strings at set distances from the anchor, and a piece goes
   to a bucket by the bytes that all its strings share. Pieces are collapsed and ordered like contexts; where a bucket is still too
   large (the edge of the passage), its few strings each get a bucket of their own.
6. The repeated places of a context hold for all its occurrences; they are merged for each document and cut out.

Digests have 128 bits where they stand for bytes (copies of a context); anchors only bring candidates together.

Cases: null and empty texts have no bytes and lose none. Equal rows repeat one another. Rows with null doc_id come
first. Matches never cross documents. Long texts are read in overlapping parts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import forget, small, table, written
from tessera.llm.simhash import _whole_groups

#: Bytes of a repeated string that is removed, of one that is told, and of the substrings that anchor it.
LENGTH, LEAST, GRAM = 400, 256, 64
#: Bytes of a text that are looked at together (places in them fit in 21 bits), and contexts of an anchor likewise.
PART, MOST = 1 << 19, 512
#: Contexts that are put in order together, about.
TOGETHER = 600
#: Strings in a piece of a context.
BLOCK = 16
#: Records in a row that a periodic stretch has at least.
PERIODS = 8

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 21) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


_LONGEST = max(PART + 2 * LENGTH, 4 * TOGETHER * 2 * LENGTH)
_UP = _powers(int(_BASE), _LONGEST)
_DOWN = _powers(pow(int(_BASE), -1, 1 << 64), _LONGEST)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def rolling(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes in a row; the same bytes give the same hash everywhere."""
    n = len(b)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[b] * _UP[:n], out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * _DOWN[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    n = len(x) - w + 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n])


def _digest(b: bytes, at: int) -> bytes:
    """128 bits of a context and of its anchor's place in it."""
    return xxhash.xxh3_128_digest(b, at)


def periodic(piece: bytes, h: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which records to keep, and the stretches (start, end, period) that repeat themselves.

    Records in a row with equal anchors at equal distances hint at a period; the bytes decide. A stretch has ``LENGTH``
    bytes and two periods at least. Its strings are those of its first period, but for those that reach beyond its end.
    """
    keep, found = np.ones(len(first), dtype=bool), []
    step = np.diff(at)
    link = np.flatnonzero(h[at[1:]] == h[at[:-1]])
    if len(link) < PERIODS:
        return keep, found
    cuts = np.flatnonzero((np.diff(link) != 1) | (np.diff(step[link]) != 0)) + 1
    lows, highs = link[np.r_[0, cuts]], link[np.r_[cuts - 1, len(link) - 1]] + 1
    for lo, hi in zip(lows, highs, strict=True):
        p, start, end = int(step[lo]), int(first[lo]), int(first[hi] + n[hi] - 1 + LEAST)
        if hi - lo < PERIODS or end - start < LENGTH + 2 * p:
            continue
        bytes_of = np.frombuffer(piece[start:end], dtype=np.uint8)
        # the longest part in which each byte equals the one a period on
        odd = np.r_[-1, np.flatnonzero(bytes_of[p:] != bytes_of[:-p]), len(bytes_of) - p]
        k = int(np.argmax(np.diff(odd)))
        start, end = start + int(odd[k]) + 1, start + int(odd[k + 1]) + p
        if end - start < LENGTH + 2 * p:
            continue
        inner = np.arange(lo, hi + 1)
        keep[inner[(first[inner] >= start + p) & (first[inner] + n[inner] - 1 <= end - LENGTH)]] = False
        found.append((start, end, p))
    return keep, found


def anchors(raw: bytes) -> Iterator[tuple[tuple[np.ndarray, ...], list[tuple[int, int, int]]]]:
    """Part by part, a text's records (anchor hash, context digests, first string, number of strings, bytes that its last
    string lacks) and its periodic stretches."""
    for start in range(0, max(0, len(raw) - LEAST + 1), PART):
        piece = raw[start : start + PART + LENGTH - 1]
        strings = min(PART, len(raw) - LEAST + 1 - start)
        h = rolling(np.frombuffer(piece, dtype=np.uint8)[: strings + LEAST - 1], GRAM)
        key = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        place = (_PLACE - (sliding_min(key, LEAST - GRAM + 1) & _PLACE)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        n = np.diff(np.r_[first, len(place)])
        keep, stretches = periodic(piece, h, first, n, place[first])
        first, n = first[keep], n[keep]
        at, stop = place[first], np.minimum(first + n + LENGTH - 1, len(piece))
        digest = [_digest(piece[a:z], p - a) for a, z, p in zip(first.tolist(), stop.tolist(), at.tolist(), strict=True)]
        yield (h[at], digest, first + start, n, first + n + LENGTH - 1 - stop), [(a + start, z + start, p) for a, z, p in stretches]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, raw): ``key`` tells apart rows of one id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))


def records(rows: DataFrame) -> DataFrame:
    """(doc_id, key, anchor, context, first, n, short) of ``rows`` as from ``keyed``.

    A row without an anchor is a periodic stretch of n bytes, ``short`` its period.
    """
    names = ["doc_id", "key", "anchor", "context", "first", "n", "short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column("raw")):
                for (anchor, context, first, n, short), stretches in anchors(raw.as_py()):
                    m = len(n) + len(stretches)
                    same = pa.array(np.full(m, i))
                    none = [None] * len(stretches)
                    starts, stops, periods = np.array(stretches, dtype=np.int64).reshape(-1, 3).T
                    columns = [
                        pa.array([*anchor.view(np.int64).tolist(), *none], pa.int64()) if none else pa.array(anchor.view(np.int64)),
                        pa.array([*context, *none], pa.binary()),
                        pa.array(np.r_[first, starts]),
                        pa.array(np.r_[n, stops - starts].astype(np.int32)),
                        pa.array(np.r_[short, periods].astype(np.int32)),
                    ]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(same), batch.column("key").take(same), *columns], names=names)

    return rows.mapInArrow(_gathered(run), "doc_id long, key long, anchor long, context binary, first long, n int, short int")


def _gathered(run, rows: int = 20_000):
    """``run`` with its small batches put together."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in run(batches):
            held.append(b)
            if sum(x.num_rows for x in held[-1:]) >= rows or len(held) >= 500:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(x.num_rows for x in held) else held[0]
                held = []
        if held and sum(x.num_rows for x in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return out


def smaller_before(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1: by jumps over what is known to be larger."""
    out = np.arange(-1, len(x) - 1)
    left = np.flatnonzero((out >= 0) & (x[out] > x))
    while len(left):
        out[left] = out[out[left]]
        left = left[(out[left] >= 0) & (x[out[left]] > x[left])]
    return out


def smaller_after(x: np.ndarray) -> np.ndarray:
    """The same towards the end; ``len(x)`` where there is none."""
    return len(x) - 1 - smaller_before(x[::-1])[::-1]


def matched(place: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Whether each place in suffix order has a previous factor of ``least`` bytes.

    ``common``: common prefix of each place in the order and the one before it. Two places share the least of these
    between them; so they share ``least`` bytes if they are in one run of that.
    """
    run = np.r_[0, np.cumsum(common < least)]
    out = np.zeros(len(place), dtype=bool)
    for near in (smaller_before(place), smaller_after(place)):
        there = np.flatnonzero((near >= 0) & (near < len(place)))
        out[there] |= run[near[there]] == run[there]
    return out


def factors(b: np.ndarray, starts: np.ndarray, stops: np.ndarray, keep_first: bool, reaches: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each of the rising lengths ``reaches``, whether the string at each of the ascending ``starts`` also stands at an
    earlier one (or, unless ``keep_first``, a later one). ``stops``: where the bytes that follow a start end."""
    out = {least: np.zeros(len(starts), dtype=bool) for least in reaches}
    # strings whose prints differ differ in their first bytes: they have no factor and need no order
    _, which, count = np.unique(rolling(b, reaches[0])[starts], return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[which] > 1)
    if not len(some):
        return out
    raw = b.tobytes()
    strings = [raw[a:z] for a, z in zip(starts[some].tolist(), np.minimum(starts[some] + reaches[-1], stops[some]).tolist(), strict=True)]
    order = sorted(range(len(some)), key=strings.__getitem__)
    in_order = [strings[i] for i in order]
    shared = lambda x, y: len(x) if x == y else reaches[0] if x[: reaches[0]] == y[: reaches[0]] else 0
    common = np.fromiter((shared(x, y) for x, y in zip(in_order, in_order[1:], strict=False)), dtype=np.int64, count=len(order) - 1)
    place = np.array(order)
    for least, flags in out.items():
        flags[some[place]] = matched(place, common, least)
        if not keep_first:
            flags[some[place]] |= matched(-place, common, least)
    return out


def longest_previous_factors(b: bytes) -> np.ndarray:
    """For each position the length of the longest string that starts there and also starts earlier, by the same steps."""
    n = len(b)
    order = np.array(sorted(range(n), key=lambda i: b[i:]), dtype=np.int64)
    share = lambda i, j: next((k for k in range(n - max(i, j)) if b[i + k] != b[j + k]), n - max(i, j))
    out = np.zeros(n, dtype=np.int64)
    for near in (smaller_before(order), smaller_after(order)):
        for k in np.flatnonzero((near >= 0) & (near < n)):
            out[order[k]] = max(out[order[k]], share(int(order[k]), int(order[near[k]])))
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of true flags."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edges[::2], edges[1::2] - 1


def contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, context, rep, size, bytes) cut from the texts of ``rows``; ``wanted``: anchor, context, rep, size."""
    by = wanted.groupBy(F.col("rep.doc_id").alias("_id"), F.col("rep.key").alias("_key")).agg(F.collect_list(F.struct("anchor", "context", "rep", "size")).alias("cuts"))
    one = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    both = rows.join(by.hint("shuffle_hash"), one).select(F.col("raw"), F.explode("cuts").alias("x"))
    cut = F.substring("raw", (F.col("x.rep.first") + 1).cast("int"), F.col("x.rep.n") + LENGTH - 1)
    # equal rows cut the same contexts
    return both.select("x.anchor", "x.context", "x.rep", "x.size", cut.alias("bytes")).dropDuplicates(["anchor", "context"])


def _some_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """(anchor, context, n, bytes) of whole anchors, of about ``TOGETHER`` contexts at once."""
    for columns in _whole_groups(batches, 1, TOGETHER):
        anchor = columns[0]
        cuts = np.r_[0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)]
        lo = 0
        for hi in cuts[1:].tolist():
            if hi - lo >= TOGETHER or hi == len(anchor):
                yield [c[lo:hi] for c in columns]
                lo = hi


PARTS = "anchor long, context binary, lo int, hi int, reach int"


def within_anchor(cut: DataFrame, keep_first: bool, reaches: tuple[int, ...] = (LEAST, LENGTH)) -> DataFrame:
    """(anchor, context, lo, hi, reach): runs of strings of a context, of ``reach`` bytes, that repeat in a context of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, context, n, raw in _some_groups(batches):
            # all anchors of the batch in one suffix order; strings of different anchors differ
            n = n.astype(np.int64)
            sizes = np.array([len(x) for x in raw])
            flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
            stop = np.cumsum(sizes)
            which = np.repeat(np.arange(len(raw)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flags = factors(flat, (stop - sizes)[which] + inner, stop[which], keep_first, reaches)
            lo, hi, own, reach = [], [], [], []
            # a run ends where its context ends
            change = np.r_[0, np.cumsum(n)]
            for least, f in flags.items():
                for i in np.unique(which[f]).tolist():
                    a, z = _runs(f[change[i] : change[i + 1]])
                    lo += a.tolist()
                    hi += z.tolist()
                    own += [i] * len(a)
                    reach += [least] * len(a)
            if own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[own]), pa.array(context[own], pa.binary()), *(pa.array(x, pa.int32()) for x in (lo, hi, reach))], names=["anchor", "context", "lo", "hi", "reach"]
                )

    order = cut.repartition("anchor").sortWithinPartitions("anchor", "rep", "context")
    return order.select("anchor", "context", "rep.n", "bytes").mapInArrow(run, PARTS)


def by_string(cut: DataFrame, keep_first: bool, reach: int) -> DataFrame:
    """As ``within_anchor`` with one length, for anchors with very many contexts: every string goes to a bucket of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, raw) in enumerate(zip(batch.column("n").to_pylist(), batch.column("bytes"), strict=True)):
                b = raw.as_py()
                same = pa.array(np.full(n, i))
                digest = pa.array([_digest(b[k : k + reach], 0) for k in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in ("anchor", "context", "at")), pa.array(np.arange(n, dtype=np.int32)), digest], names=["anchor", "context", "at", "lo", "string"])

    at = F.struct("rep.doc_id", "rep.key", "rep.first")
    strings = cut.select("anchor", "context", at.alias("at"), "rep.n", "bytes")
    strings = written(strings.mapInArrow(_gathered(run), "anchor long, context binary, at struct<doc_id: long, key: long, first: long>, lo int, string binary"))
    place = F.struct("at", "context", "lo")
    runs = written(strings.groupBy(F.col("anchor").alias("_a"), F.col("string").alias("_s")).agg(F.count("*").alias("k"), F.min(place).alias("least")).where("k > 1"))
    hit = strings.join(small(runs), (F.col("anchor") == F.col("_a")) & (F.col("string") == F.col("_s")))
    if keep_first:
        hit = hit.where(place != F.col("least"))
    return hit.select("anchor", "context", "lo", F.col("lo").alias("hi"), F.lit(reach).alias("reach"))


def pieces(cut: DataFrame, reach: int) -> DataFrame:
    """(anchor, context, rep, bytes, of_anchor, of_context, at): contexts in pieces of ``BLOCK`` strings of ``reach`` bytes; ``at`` is a piece's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (m, raw) in enumerate(zip(batch.column("n").to_pylist(), batch.column("bytes"), strict=True)):
                b = raw.as_py()
                h = rolling(np.frombuffer(b, dtype=np.uint8), GRAM)[: LEAST - GRAM + 1]
                key = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
                place = int(np.argmin(key))
                a, m = 0, min(m, len(b) - reach + 1)
                while a < m:
                    # the pieces end at multiples of BLOCK before the anchor; the core is in every string that starts there
                    k = (place - a) // BLOCK
                    z = min(m, place - k * BLOCK + 1)
                    core = xxhash.xxh64_intdigest(b[place - k * BLOCK : place - k * BLOCK - BLOCK + 1 + reach], k)
                    body = b[a : z + reach - 1]
                    rows.append((i, core, _digest(body, place - a), body, a, z - a))
                    a = z
            if rows:
                i, core, own, body, at, n = zip(*rows, strict=True)
                same = pa.array(i, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(core, dtype=np.uint64).view(np.int64)), pa.array(own, pa.binary()), batch.column("rep").take(same), pa.array(body, pa.binary()), batch.column("anchor").take(same), batch.column("context").take(same), *(pa.array(x, pa.int32()) for x in (at, n))],
                    names=["core", "context", "rep", "bytes", "of_anchor", "of_context", "at", "n"],
                )

    kind = cut.schema["rep"].dataType.simpleString()
    out = cut.select("anchor", "context", "rep", "rep.n", "bytes").mapInArrow(run, f"core long, context binary, rep {kind}, bytes binary, of_anchor long, of_context binary, at int, n int")
    rep = F.struct("rep.doc_id", "rep.key", "rep.first", "n")
    return out.select(F.xxhash64("of_anchor", "core").alias("anchor"), "context", rep.alias("rep"), "bytes", "of_anchor", "of_context", "at")


def run(hi: Column, reach: int) -> Column:
    return F.struct(F.lit(0).alias("lo"), hi.cast("int").alias("hi"), F.lit(reach).alias("reach"))


def found_in(each: DataFrame, kinds: DataFrame, partial: DataFrame, own: Column, whole: Column, keep_first: bool) -> DataFrame:
    """``each`` (anchor, context, ...) with x (lo, hi, reach): the repeated strings of its context.

    ``kinds``: anchor, context, count, rep; ``partial``: as from ``within_anchor``; ``own``: an occurrence's place; ``whole``: all
    strings of a context. They repeat if it occurs again; its first occurrence stays if the first is to be kept.
    """
    parts = partial.groupBy("anchor", "context").agg(F.collect_set(F.struct("lo", "hi", "reach")).alias("parts"))
    known = kinds.join(parts, ["anchor", "context"], "left").where("count > 1 or parts is not null")
    known = written(known.select(F.col("anchor").alias("_a"), F.col("context").alias("_c"), "count", F.struct("rep.doc_id", "rep.key", "rep.first").alias("_rep"), "parts"))
    hit = each.join(small(known), (F.col("anchor") == F.col("_a")) & (F.col("context") == F.col("_c")))
    again = ~own.eqNullSafe(F.col("_rep")) if keep_first else F.col("count") > 1
    return hit.withColumn("x", F.explode(F.when(again, whole).otherwise(F.col("parts"))))


def refined(cut: DataFrame, keep_first: bool, most: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """As ``within_anchor`` with one length, for anchors with very many contexts; and the table that it reads."""
    each = written(pieces(cut, reach))
    kinds = each.groupBy("anchor", "context").agg(F.count("*").alias("count"), F.min("rep").alias("rep"))
    often = written(kinds.groupBy(F.col("anchor").alias("_b")).agg(F.count("*").alias("size")))
    kinds = written(kinds.join(small(often), F.col("anchor") == F.col("_b")).drop("_b").where("size > 1 or count > 1"))
    of = kinds.where("size > 1").select(F.col("anchor").alias("_a"), F.col("context").alias("_c"), F.col("rep").alias("_rep"), "size")
    first = each.join(of, (F.col("anchor") == F.col("_a")) & (F.col("context") == F.col("_c")) & F.col("rep").eqNullSafe(F.col("_rep")))
    reps = written(first.select("anchor", "context", "rep", "bytes", "size").dropDuplicates(["anchor", "context"]))
    partial = within_anchor(reps.where(F.col("size") <= most), keep_first, (reach,)).unionByName(by_string(reps.where(F.col("size") > most), keep_first, reach))
    whole = F.array(run(F.col("rep.n") - 1, reach))
    hit = found_in(each.drop("bytes"), kinds.drop("size"), partial, F.struct("rep.doc_id", "rep.key", "rep.first"), whole, keep_first)
    return hit.select(F.col("of_anchor").alias("anchor"), F.col("of_context").alias("context"), (F.col("at") + F.col("x.lo")).alias("lo"), (F.col("at") + F.col("x.hi")).alias("hi"), "x.reach"), each


def removals(rows: DataFrame, keep_first: bool = False, most: int = MOST) -> DataFrame:
    """(doc_id, key, spans, passages): for each text with repeated strings, the (start, end) ranges of those of ``LENGTH``
    bytes and of those of ``LEAST`` bytes."""
    found = written(records(rows))
    often = found.where("anchor is not null").groupBy(F.col("anchor").alias("_a")).agg(F.count("*").alias("_n"), (F.min("context") != F.max("context")).alias("several")).where("_n > 1")
    # joins are between written tables, so that Spark may split the rows of an anchor that is very common
    near = written(found.join(small(written(often.drop("_n"))), F.col("anchor") == F.col("_a")).drop("_a"))
    own = written(found.where("anchor is null").select("doc_id", "key", (F.col("first") + (F.col("short") if keep_first else 0)).alias("start"), (F.col("first") + F.col("n")).alias("end"), F.explode(F.array(F.lit(LEAST), F.lit(LENGTH))).alias("reach")))
    forget(found)
    kinds = near.groupBy("anchor", "context", "several").agg(F.count("*").alias("count"), F.min(F.struct("doc_id", "key", "first", "n", "short")).alias("rep"))
    kinds = written(kinds.where("several or count > 1"))
    sizes = written(kinds.where("several").groupBy(F.col("anchor").alias("_a")).agg(F.count("*").alias("size")))
    cut = written(contexts(rows, kinds.where("several").join(small(sizes), F.col("anchor") == F.col("_a")).select("anchor", "context", "rep", "size")))
    partial = within_anchor(cut.where(F.col("size") <= most), keep_first)
    large, used = cut.where(F.col("size") > most), []
    if not large.isEmpty():
        for reach in (LEAST, LENGTH):
            more, each = refined(large, keep_first, most, reach)
            partial = partial.unionByName(more)
            used.append(each)
    whole = F.array_compact(F.array(run(F.col("n") - 1, LEAST), F.when(F.col("n") > F.col("short"), run(F.col("n") - 1 - F.col("short"), LENGTH))))
    hit = found_in(near.drop("several"), kinds.drop("several"), written(partial), F.struct("doc_id", "key", "first"), whole, keep_first)
    forget(cut, *used)
    spans = hit.select("doc_id", "key", (F.col("first") + F.col("x.lo")).alias("start"), (F.col("first") + F.col("x.hi") + F.col("x.reach")).alias("end"), "x.reach")
    spans = spans.unionByName(own).distinct()
    listed = lambda least, name: F.sort_array(F.collect_list(F.when(F.col("reach") == least, F.struct("start", "end")))).alias(name)
    return spans.groupBy("doc_id", "key").agg(listed(LENGTH, "spans"), listed(LEAST, "passages"))


def _merged(found: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s in found or []:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return out


def cut_out(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, key, n_bytes, spans, passages, kept): merged ranges and what remains of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.list_(pa.int64()))
        for batch in (x.slice(at, 500) for x in batches for at in range(0, x.num_rows, 500)):
            spans, passages, kept, sizes = [], [], [], []
            for raw, found, told in zip(batch.column("raw"), batch.column("spans"), batch.column("passages"), strict=True):
                b, merged = raw.as_py(), _merged(found.as_py())
                ends = [0, *(x for m in merged for x in m), len(b)]
                kept.append(b"".join(b[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True)))
                spans.append(merged)
                passages.append(_merged(told.as_py()))
                sizes.append(len(b))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(spans, ranges), pa.array(passages, ranges), pa.array(kept, pa.binary())],
                names=["doc_id", "key", "n_bytes", "spans", "passages", "kept"],
            )

    said = spans.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans", "passages").hint("shuffle_hash")
    both = rows.join(said, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return both.select("doc_id", "key", "raw", "spans", "passages").mapInArrow(run, "doc_id long, key long, n_bytes long, spans array<array<long>>, passages array<array<long>>, kept binary")


def dedup(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """``cut_out`` of ``docs`` (doc_id, text)."""
    rows = keyed(docs)
    return cut_out(rows, removals(rows, keep_first))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest; then the bytes under repeated strings of ``LEAST`` bytes."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_first=False)
    size = lambda ranges: F.aggregate(ranges, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    digest = (size("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return out.select("doc_id", "n_bytes", *digest, size("passages").alias("n_passage"))
