"""Benchmark decontamination by the q-gram lemma.

A benchmark item is lower-cased and reduced to letters, digits and single spaces; those over ``WINDOW`` bytes are cut into
windows of that length, one at every ``STEP`` bytes and one at the end. So a passage of ``WINDOW + STEP - 1`` bytes holds a
whole window wherever it lies in its item. A document region within ``e`` edits of a window of length m has at least
m - q + 1 - q e of its q-grams, and they lie on diagonals (position in the document less position in the window) at most ``e`` apart. So:

1. every q-gram of a document is looked up among the windows' (a bitmap first, then exactly);
2. hits are counted in bands of diagonals, each overlapping the next by half, so that one holds the whole of a region;
3. bands that meet the window's bound are verified by an alignment inside the band.

The documents pass once, without an exchange. The benchmark is taken in blocks of at most ``BLOCK`` bytes of text, whose
tables have a size in proportion to that; a larger benchmark takes more passes.

Cases: null and empty texts are clean; null or empty items find nothing. Items shorter than q have to occur exactly, as
whole words. Repeated documents each get their row. Null ids are carried along. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import packed, table

Q = 8
#: Edits in a hundred characters that a copy may have.
EDITS = 10
#: Windows of longer items, and the step from one to the next.
WINDOW, STEP = 84, 12
#: Half the width of a band; no less than the edits that any window allows.
HALF = 9
#: Alignments made together, and their steps between looks at which of them can still succeed.
ALIGNED, STEPS = 4096, 8
#: Bytes of benchmark text in a block, and of document text looked at together.
BLOCK, AT_ONCE = 1 << 20, 1 << 20
#: Hits of q-grams that are counted together, about.
POSTS = 1 << 20
#: Bits of the address in the first lookup.
ADDRESS = 22

_SPACE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower-cased UTF-8 with runs of anything but letters and digits as one space."""
    return re.sub(rb" +", b" ", (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACE)).strip()


def grams(b: np.ndarray) -> np.ndarray:
    """The q-grams of bytes as numbers, by doubling."""
    x = b.astype(np.uint64)
    for by in (1, 2, 4):
        x = x[: len(x) - by] | x[by:] << np.uint64(8 * by) if len(x) > by else x[:0]
    return x


def address(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ADDRESS)


class Windows:
    """The windows of a block of items and a table of their items' q-grams.

    A q-gram stands in the table once for each place of an item, however many windows hold that place: hits are counted by
    places of a band, and a window's hits are those from its first place to its last.
    """

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.item, self.text = [], []
        first, all_grams, places, at = [], [], [], 0
        for i, t in items:
            b = plain(t)
            if b:
                last = max(0, len(b) - WINDOW)
                for s in [*range(0, last, STEP), last]:
                    self.item.append(i)
                    self.text.append(b[s : s + WINDOW])
                    first.append(at + s)
                all_grams.append(grams(np.frombuffer(b, dtype=np.uint8)))
                places.append(at + np.arange(len(all_grams[-1])))
                at += len(b) + WINDOW  # no span of places reaches into the next item
        m = np.array([len(t) for t in self.text], dtype=np.int64)
        # no more edits than leave a shared q-gram
        self.edits = np.clip(np.minimum(m * EDITS // 100, (m - Q) // Q), 0, HALF)
        self.least = np.maximum(m - Q + 1 - Q * self.edits, 1)
        self.short = [k for k, t in enumerate(self.text) if len(t) < Q]
        #: first and last place of a window's q-grams
        self.start = np.array(first, dtype=np.int64)
        self.end = self.start + m - Q
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *all_grams])
        place = np.concatenate([np.zeros(0, dtype=np.int64), *places])
        order = np.argsort(flat, kind="stable")
        self.grams, self.n = np.unique(flat, return_counts=True)
        #: gram and place as one number, ascending
        self.posts = np.repeat(np.arange(len(self.grams)), self.n) << 32 | place[order]
        self.size = at
        self.seen = np.zeros(1 << ADDRESS, dtype=bool)
        self.seen[address(self.grams)] = True
        #: the least bound of the windows at each place
        self.bound = np.full(at + 1, 1 << 14, dtype=np.int16)
        for k in np.flatnonzero(m >= Q):
            part = self.bound[self.start[k] : self.end[k] + 1]
            np.minimum(part, self.least[k], out=part)

    def bands(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal) of the bands over the bytes ``b`` that meet their window's bound."""
        none = np.zeros(0, dtype=np.int64)
        g = grams(b)
        at = np.flatnonzero(self.seen[address(g)])
        if not len(at) or not len(self.grams):
            return none, none
        k = np.searchsorted(self.grams, g[at])
        same = self.grams[np.minimum(k, len(self.grams) - 1)] == g[at]
        at, k = at[same], k[same]
        if not len(at):
            return none, none
        # cut where enough hits have come together; what one band holds of a window is whole in one of the pieces
        reach = WINDOW + 2 * HALF
        total = np.cumsum(self.n[k])
        out, lo = [], 0
        while lo < len(at):
            base = total[lo - 1] if lo else 0
            to = max(int(np.searchsorted(total, base + POSTS, side="right")), int(np.searchsorted(at, at[lo] + reach, side="right")))
            upto = int(np.searchsorted(at, at[min(to, len(at)) - 1] + reach, side="right"))
            out += self._piece(at[lo:upto], k[lo:upto], 0, self.size)
            lo = to
        window, first = np.array(sorted(set(out)), dtype=np.int64).reshape(-1, 2).T
        return window, first

    def _piece(self, at: np.ndarray, k: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
        """The bands of hits at ``at`` of the q-grams ``k``, with places from ``low`` to ``high``."""
        first, last = np.searchsorted(self.posts, k << 32 | low), np.searchsorted(self.posts, k << 32 | high)
        n = last - first
        if not n.sum():
            return []
        if n.sum() > 4 * POSTS and high - low > 8 * WINDOW:
            middle = (low + high) // 2
            return self._piece(at, k, low, middle + WINDOW) + self._piece(at, k, middle, high)
        place = self.posts[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())] & 0xFFFFFFFF
        diagonal = np.repeat(at, n) - place + self.size
        # a place counts once in a band, however often the document repeats its q-gram there
        keys = np.sort(np.concatenate([((diagonal + h) // (2 * HALF) * 2 + (h > 0)) << 32 | place for h in (0, HALF)]))
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        # as many hits as the least bound here asks for, no further on than a window reaches
        far = np.arange(len(keys)) + self.bound[keys & 0xFFFFFFFF] - 1
        able = np.flatnonzero(far < len(keys))
        near = keys[able[keys[far[able]] <= keys[able] + (WINDOW - Q)]]
        band, place = near >> 32, near & 0xFFFFFFFF
        out: set[tuple[int, int]] = set()
        window = np.searchsorted(self.start, place, side="right") - 1
        # windows begin at every STEP places, and one more at an item's end
        for back in range(WINDOW // STEP + 2):
            w = window - back
            inside = (w >= 0) & (self.end[np.maximum(w, 0)] >= place)
            pairs = np.unique(np.stack([w[inside], band[inside]], axis=1), axis=0)
            w, on = pairs[:, 0], pairs[:, 1]
            count = np.searchsorted(keys, on << 32 | self.end[w], side="right") - np.searchsorted(keys, on << 32 | self.start[w])
            good = count >= self.least[w]
            w, on = w[good], on[good]
            out.update(zip(w.tolist(), ((on // 2) * 2 * HALF - (on % 2) * HALF - self.size + self.start[w]).tolist(), strict=True))
        return list(out)

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text number, window, edits) of the regions found; the least edits for each text and window."""
        gap = b"\0" * Q
        joined = gap.join(texts)
        ends = np.cumsum([len(t) + Q for t in texts]).tolist()
        found: dict[tuple[int, int], int] = {}
        ask: list[tuple[int, int, bytes]] = []
        for w, first in zip(*(x.tolist() for x in self.bands(np.frombuffer(joined, dtype=np.uint8))), strict=True):
            p, e = self.text[w], int(self.edits[w])
            lo, hi = max(0, first - e), min(len(joined), first + 2 * HALF + len(p) + e)
            middle = min(max(first + HALF + len(p) // 2, lo), hi - 1)
            for i in {bisect_right(ends, x) for x in (lo, middle, hi - 1)}:
                if i < len(texts) and found.get((i, w)) != 0:
                    start = ends[i] - len(texts[i]) - Q
                    region = joined[max(lo, start) : min(hi, start + len(texts[i]))]
                    if p in region:
                        found[i, w] = 0
                    elif e and len(region) >= len(p) - e:
                        ask.append((i, w, region))
        # patterns of one length are aligned together
        ask.sort(key=lambda x: len(self.text[x[1]]))
        at = 0
        while at < len(ask):
            size = len(self.text[ask[at][1]])
            part = [x for x in ask[at : at + ALIGNED] if len(self.text[x[1]]) == size]
            at += len(part)
            e = int(self.edits[part[0][1]])
            for (i, w, _), d in zip(part, edits_inside([self.text[w] for _, w, _ in part], [r for _, _, r in part], e).tolist(), strict=True):
                if d <= e:
                    found[i, w] = min(d, found.get((i, w), e))
        for w in self.short:
            for i, t in enumerate(texts):
                if b" " + self.text[w] + b" " in b" " + t + b" ":
                    found[i, w] = 0
        return [(i, w, d) for (i, w), d in found.items()]


def edits_inside(patterns: list[bytes], regions: list[bytes], most: int) -> np.ndarray:
    """Edit distance of each pattern (all of one length) to the nearest part of its region, or ``most + 1`` if it is over ``most``.

    The regions are those of bands: as long as a pattern and the band's width, which bounds each row of the alignments.
    """
    m, n = len(patterns[0]), max(map(len, regions))
    p = np.frombuffer(b"".join(patterns), dtype=np.uint8).reshape(-1, m)
    # no pattern holds a zero, so that what is filled up matches nothing
    r = np.frombuffer(b"".join(x.ljust(n, b"\0") for x in regions), dtype=np.uint8).reshape(-1, n)
    out = np.full(len(p), most + 1, dtype=np.int16)
    left = np.arange(len(p))
    steps = np.arange(n + 1, dtype=np.int16)
    row = np.zeros((len(p), n + 1), dtype=np.int16)
    width = max(0, n - m) + most
    for i in range(1, m + 1):
        # cells outside the band of diagonals cost too much to matter
        lo, hi = max(0, i - most - 1), min(n, i + width + 1)
        at = max(lo, 1)
        new = np.full_like(row, most + 1)
        new[:, lo : hi + 1] = row[:, lo : hi + 1] + 1
        new[:, at : hi + 1] = np.minimum(new[:, at : hi + 1], row[:, at - 1 : hi] + (r[:, at - 1 : hi] != p[:, i - 1 : i]))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        if i % STEPS == 0 or i == m:
            able = row.min(axis=1) <= most
            if not able.all():
                left, p, r, row = left[able], p[able], r[able], row[able]
            if not len(left):
                return out
    out[left] = row.min(axis=1)
    return out


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item_id, edits) for each document and item found in it; ``docs``: row (any type), text; items: item_id, text."""
    spark = docs.sparkSession
    row_type = docs.schema["row"].dataType.simpleString()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = total // BLOCK + 1
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select(F.col("item_id").cast("long"), "text")
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()]))
        hits = docs.mapInArrow(_search(windows), f"row {row_type}, item_id long, edits int")
        out = hits if out is None else out.unionByName(hits)
    return out


def _search(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for batch in batches:
            texts, rows, size = [], [], 0
            column = batch.column("text")
            picked, item, edits = [], [], []
            for at in range(batch.num_rows + 1):
                if at == batch.num_rows or size >= AT_ONCE:
                    best: dict[tuple, int] = {}
                    for i, k, d in w.find(texts) if texts else []:
                        best[rows[i], w.item[k]] = min(d, best.get((rows[i], w.item[k]), d))
                    for (i, j), d in sorted(best.items(), key=str):
                        picked.append(i), item.append(j), edits.append(d)
                    texts, rows, size = [], [], 0
                if at < batch.num_rows:
                    texts.append(plain(column[at].as_py()))
                    rows.append(at)
                    size += len(texts[-1])
            if picked:
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(picked)), pa.array(item, pa.int64()), pa.array(edits, pa.int32())], names=["row", "item_id", "edits"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that holds an item or a window of one: its id, the items, and the least edits."""
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", F.monotonically_increasing_id().alias("n")).alias("row"), "text")
    hits = found(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    by = hits.groupBy("row").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"), F.min("edits").alias("edits"))
    return by.select("row.doc_id", "n_items", F.col("items").cast("array<long>").alias("items"), F.col("edits").cast("long").alias("edits"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    key = F.xxhash64("doc_id", "text").alias("key")
    rows = docs.select(F.struct("doc_id", key).alias("row"), "text")
    hits = found(rows, table(spark, sf_dir, "benchmark").select("item_id", "text")).select("row.*").distinct()
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    whole = docs.select(packed(docs).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("doc_id", "text").alias("_hash"))
    near = whole.join(hits, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left_anti")
    return near.select("_row.*")
