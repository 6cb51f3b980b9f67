"""Token ids as Parquet list columns, written in document order and read selectively.

File format: a folder of Parquet files. Rows stand in ascending ``doc_id`` order (null first) within a file and from
file to file. Columns: ``part`` (number of the file), ``doc_id``, ``before`` (ids of the part's earlier documents),
``n_tokens``, ``ids`` (list of int). ``ids`` is dictionary encoded, which keeps an id of this vocabulary in 16 bits;
``doc_id``, ``before`` and ``n_tokens`` are delta encoded by the format's second version where they have no small
dictionary. Row groups are of a set size, and pages carry their own minima and maxima: a filter on ``doc_id`` reads the
pages it needs, a query on lengths reads none of the ids. ``offsets`` gives each part's first position in the stream.

Work: one range exchange of the documents by ``doc_id``, a sort inside each partition, and one Arrow pass that
encodes. Prefix sums are within a part plus one row for each part; nothing else is gathered.

Speed: what stands between white space is encoded once for each worker and kept in a table of bounded size; see
``Encoder``. A tokenizer for which that does not hold is recognised by its file and encodes whole texts.

Cases: a null or empty text has the end id alone. Repeated rows are separate documents next to one another. A null
``doc_id`` comes first. An empty table gives an empty folder and an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import scratch_dir, small, table, written

#: Rows of a parquet page, bytes of a row group and of a page.
WRITER = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "compression": "zstd"}

#: Words and pieces that a worker remembers before it starts anew, and the length from which one is not remembered.
REMEMBERED, LONG = 800_000, 64

SCHEMA = "part int, doc_id long, before long, n_tokens int, ids array<int>"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The pattern by which the tokenizer splits a text into words, and the end of a special token's name.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "|>"

#: The same pattern on lower-cased texts of ASCII and Latin-1 letters, for which no normal form changes a thing. Four
#: control characters are left out, which are white space to ``str.split`` and symbols to the pattern.
PLAIN = re.compile("[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]*")
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Pieces(dict):
    """ids of lower-case plain pieces of texts; words are such pieces, and others are put together from them."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            got = self.encode(piece)
        elif piece[:-1].isalpha() and not piece[-1].isalnum():
            got = self[piece[:-1]] + self[piece[-1]]
        else:
            words = WORD.findall(piece)
            got = self.encode(piece) if len(words) == 1 else b"".join([self[w] for w in words])
        if len(piece) < LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """ids of texts as bytes of int32, with ``end`` appended to each.

    A tokenizer that splits by ``SPLIT`` always cuts at white space. Texts are cut there, and each piece is encoded once
    while it is remembered; one with other letters is given to the tokenizer. With any other tokenizer, texts are encoded
    whole.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end], dtype=np.int32).tobytes()
        self.pieces, self.others = Pieces(self._word), {}
        self.letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        parts = said["pre_tokenizer"].get("pretokenizers", []) if said["pre_tokenizer"] else []
        split = parts[0].get("pattern", {}).get("Regex") if parts else None
        norm = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        added = said["added_tokens"]
        self.by_word = split == SPLIT and norm == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and not any(t["lstrip"] or t["rstrip"] or not t["content"].endswith(SPECIAL) for t in added)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32).tobytes()

    def _word(self, word: str) -> bytes:
        letters = self.letters
        spelled = word if word.isascii() and word.isalnum() else "".join(letters[b] for b in word.encode())
        return array("i", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))

    def _piece(self, piece: str) -> bytes:
        """One of a text that isn't plain."""
        if PLAIN.fullmatch(piece) and SPECIAL not in piece:
            return self._plain(piece)
        got = self.others.get(piece)
        if got is None:
            got = self._encode(piece)
            if len(piece) < LONG:
                if len(self.others) >= REMEMBERED // 4:
                    self.others.clear()
                self.others[piece] = got
        return got

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not self.by_word:
            return self._encode(text) + self.end
        if PLAIN.fullmatch(text) and SPECIAL not in text:
            return self._plain(text) + self.end
        return b"".join(map(self._piece, text.replace("\n", " ").split(" "))) + self.end


@functools.lru_cache(maxsize=2)
def encoder(path: str, end: int) -> Encoder:
    """One for each worker process, which its tasks share."""
    return Encoder(path, end)


def encoded(docs: DataFrame, path: str, end: int, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) as rows of the file format, in order in and between partitions.

    Rows of one id (null, say) follow one another by a hash of their text, and may lie in several partitions.
    """
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    # the ranges are found from ids alone, without the texts, unless an id has more rows than a part should; the order is the same
    most, rows = hashed.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    keys = ["doc_id"] if (most or 0) <= (rows or 0) // (8 * parts) + 1 else ["doc_id", "hash"]
    ordered = hashed.repartitionByRange(parts, *keys).sortWithinPartitions("doc_id", "hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(path, end), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                blobs = [encode(t) for t in rows.column("text").to_pylist()]
                n = np.fromiter((len(b) // 4 for b in blobs), dtype=np.int64, count=len(blobs))
                ends = np.concatenate([[0], np.cumsum(n)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(blobs), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("part"), rows.column("doc_id"), pa.array(before + ends[:-1]), pa.array(n.astype(np.int32)), ids],
                    names=["part", "doc_id", "before", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    return ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, to: str, path: str | None = None, end: int = 1, part_bytes: int = 16 << 20) -> None:
    """Encodes ``docs`` (doc_id, text) with the tokenizer file ``path`` and writes the ids to the folder ``to``."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, size // part_bytes))
    encoded(docs, path or vocabulary(), end, parts).write.options(**WRITER).parquet(to)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the file format; select columns and filter by ``doc_id`` to read less."""
    return spark.read.schema(SCHEMA).parquet(path)


def offsets(rows: DataFrame) -> DataFrame:
    """Each part's first position in the stream: (part, first). Reads ``part`` and ``n_tokens`` only."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))


def checksums(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids_crc32``, that of the ids as little-endian unsigned 32-bit integers, in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "before", "n_tokens")), pa.array(crc, pa.int64())], names=["part", "doc_id", "before", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "part int, doc_id long, before long, n_tokens int, ids_crc32 long")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of a folder."""
    at = small(written(offsets(rows)))
    out = checksums(rows).join(at, F.col("part") == F.col("_part"))
    return out.select("doc_id", (F.col("first") + F.col("before")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the documents' token files, which stay in the shared folder."""
    to = scratch_dir(spark)
    write(docs.select("doc_id", "text"), to)
    return digest(read(spark, to))
