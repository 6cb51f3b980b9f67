"""The history of a repository as rows, read by many tasks, with renames followed.

The planner asks for the hashes of the commits alone. Tasks read what a run of them changes (``git log --raw``), and the texts of
the blobs that are asked for (``git cat-file --batch``), so that no history and no text passes through the driver. On a
cluster the repository has to be a folder that all executors see.

Following a file: a name's commits fall into *spans*, cut where a rename brings the name into being. A span leads to
the one of the old name just before the rename. A file's history is its latest span with all that lie behind it, found by
doubling: after k rounds each span knows 2 ** k spans behind it.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.common import saved

NAME = "tessera_commits"
#: Commits of a task.
TASK_COMMITS = 1000


@dataclass
class Run(InputPartition):
    first: int
    hashes: list[str]


class Reader(DataSourceReader):
    def __init__(self, root: str, revision: str, since: str | None):
        self.root, self.revision, self.since = root, revision, since

    def partitions(self) -> list[InputPartition]:
        said = subprocess.run(["git", "-C", self.root, "rev-list", "--topo-order", *([f"--since={self.since}"] if self.since else []), self.revision], capture_output=True, text=True)
        hashes = said.stdout.split() if said.returncode == 0 else []
        return [Run(i, hashes[i : i + TASK_COMMITS]) for i in range(0, len(hashes), TASK_COMMITS)] or [Run(0, [])]

    def read(self, partition: Run) -> Iterator[tuple]:
        if not partition.hashes:
            return
        args = ["git", "-C", self.root, "log", "--no-walk=unsorted", "--stdin", "--raw", "-z", "-M", "--no-abbrev", "--format=%x01%H %ct"]
        said = subprocess.run(args, input="\n".join(partition.hashes).encode(), capture_output=True, check=True).stdout.decode("utf-8", "replace")
        order = {h: partition.first + i for i, h in enumerate(partition.hashes)}
        for part in said.split("\x01")[1:]:
            head = re.match(r"(\w+) (\d+)[\0\n]*", part)
            h, when = head[1], head[2]
            fields = iter(part[head.end() :].split("\0"))
            for said_of in fields:
                said_of = said_of.strip("\n")
                if not said_of.startswith(":"):
                    continue
                _, _, old_blob, new_blob, status = said_of[1:].split(" ")
                old = next(fields)
                new = next(fields) if status[0] in "RC" else old
                yield h, int(when), order[h], status[0], old, new, old_blob, new_blob


class Commits(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "hash string, t long, back long, status string, old_file string, file string, old_blob string, blob string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["root"], self.options.get("revision", "HEAD"), self.options.get("since"))


def changes(spark: SparkSession, root: str, since: str | None = None, revision: str = "HEAD") -> DataFrame:
    """(hash, ts, back, status, old_file, file, old_blob, blob) for each file that each commit changes; ``back`` counts from the newest.

    Empty without a repository. Merges change nothing of their own.
    """
    spark.dataSource.register(Commits)
    read = spark.read.format(NAME).option("root", root).option("revision", revision)
    rows = (read.option("since", since) if since else read).load()
    return rows.select("hash", F.timestamp_seconds("t").alias("ts"), "back", "status", "old_file", "file", "old_blob", "blob")


def touches(changed: DataFrame) -> DataFrame:
    """(hash, ts, back, file, born_of, old_blob, blob): a row for each name that a commit touches; a rename touches both.

    ``born_of``: the name that the file had before this commit.
    """
    none = F.lit("0" * 40)
    both = F.when(F.col("status") == "R", F.array(
        F.struct(F.col("file").alias("file"), F.col("old_file").alias("born_of"), F.col("old_blob").alias("old_blob"), F.col("blob").alias("blob")),
        F.struct(F.col("old_file").alias("file"), F.lit(None).cast("string").alias("born_of"), F.col("old_blob").alias("old_blob"), none.alias("blob")),
    ))
    one = F.array(F.struct(F.col("file").alias("file"), F.lit(None).cast("string").alias("born_of"), F.col("old_blob").alias("old_blob"), F.col("blob").alias("blob")))
    return changed.select("hash", "ts", "back", F.explode(F.coalesce(both, one)).alias("x")).select("hash", "ts", "back", "x.*")


def spans(touched: DataFrame) -> DataFrame:
    """``touched`` with ``span``: the ``back`` of the rename that its name's span begins with, or a number after all."""
    newest_first = Window.partitionBy("file").orderBy(F.col("back").desc())
    born = F.when(F.col("born_of").isNotNull(), F.col("back"))
    begin = F.last(born, ignorenulls=True).over(newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return touched.withColumn("span", F.coalesce(begin, F.lit((1 << 62))))


def behind(touched: DataFrame) -> DataFrame:
    """(file, span, far_file, far_span, after): each span with itself and all spans behind it. ``touched`` has spans.

    Of a span behind, the commits before a rename count: those with ``back`` over ``after``. That is null for the span itself.
    By doubling: a round joins what a span knows with what the last of them knows.
    """
    starts = touched.where("born_of is not null").select("file", "span", F.col("born_of").alias("_old"), "back")
    # the span of the old name just before: the youngest of those that begin further back
    old = touched.select(F.col("file").alias("file"), F.col("span").alias("at"), F.lit(None).cast("string").alias("asks"), F.lit(None).cast("long").alias("of")).distinct()
    ask = starts.select(F.col("_old").alias("file"), F.col("back").alias("at"), F.col("file").alias("asks"), F.col("span").alias("of"))
    order = Window.partitionBy("file").orderBy(F.col("at").desc(), F.col("asks").asc_nulls_last())
    begun = F.when(F.col("asks").isNull(), F.col("at"))
    met = old.unionByName(ask).withColumn("begun", F.last(begun, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    step = met.where("asks is not null and begun is not null").select(F.col("asks").alias("file"), F.col("of").alias("span"), F.col("file").alias("to_file"), F.col("begun").alias("to_span"), F.col("at").alias("after"))
    jump = saved(step)
    known = saved(touched.select("file", "span", F.col("file").alias("far_file"), F.col("span").alias("far_span"), F.lit(None).cast("long").alias("after")).distinct())
    while not jump.isEmpty():
        on = lambda f, s: (F.col(f) == F.col("_f")) & (F.col(s) == F.col("_s"))
        there = known.select(F.col("file").alias("_f"), F.col("span").alias("_s"), "far_file", "far_span", F.col("after").alias("_after"))
        far = jump.join(there, on("to_file", "to_span")).select("file", "span", "far_file", "far_span", F.coalesce("_after", "after").alias("after"))
        known = saved(known.unionByName(far).distinct())
        then = jump.select(F.col("file").alias("_f"), F.col("span").alias("_s"), F.col("to_file").alias("_tf"), F.col("to_span").alias("_ts"), F.col("after").alias("_after"))
        jump = saved(jump.join(then, on("to_file", "to_span")).select("file", "span", F.col("_tf").alias("to_file"), F.col("_ts").alias("to_span"), F.col("_after").alias("after")))
    return known


def followed(changed: DataFrame) -> DataFrame:
    """(file, hash, ts, back, name, old_blob, blob): the commits of each file under all the names that it has had, as ``git log --follow`` tells.

    ``file`` is the file's last name. Of a name that was given up and taken again, the latest file is meant.
    """
    touched = saved(spans(touches(changed)))
    # the latest span of a name is that of its newest commit, which a rename away may have ended
    latest = touched.groupBy("file").agg(F.min_by("span", "back").alias("span"))
    chain = behind(touched).join(latest, ["file", "span"]).select("file", "far_file", "far_span", "after")
    each = touched.select(F.col("file").alias("name"), F.col("span").alias("_span"), "hash", "ts", "back", "old_blob", "blob")
    held = chain.join(each, (F.col("far_file") == F.col("name")) & (F.col("far_span") == F.col("_span"))).where("after is null or back > after")
    return held.select("file", "hash", "ts", "back", "name", "old_blob", "blob")


def texts(blobs: DataFrame, root: str) -> DataFrame:
    """(blob, text) of distinct ``blobs`` (blob), read by the tasks; what git doesn't have is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names = batch.column("blob").slice(at, 256).to_pylist()
                said = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input="".join(f"{n}\n" for n in names).encode(), capture_output=True, check=True).stdout
                got, place = [], 0
                while place < len(said):
                    end = said.index(b"\n", place)
                    head, place = said[place:end].split(b" "), end + 1
                    if head[-1] != b"missing":
                        size = int(head[2])
                        got.append((head[0].decode(), said[place : place + size].decode("utf-8", "replace")))
                        place += size + 1
                blob, text = zip(*got, strict=True) if got else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(blob, pa.string()), pa.array(text, pa.string())], names=["blob", "text"])

    return blobs.select("blob").mapInArrow(run, "blob string, text string")


def occurrences(text: Column, needle: Column) -> Column:
    n = F.floor((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle))
    return F.when(F.length(needle) > 0, F.coalesce(n, F.lit(0))).otherwise(F.lit(0))


def pickaxe(history: DataFrame, needles: DataFrame, blobs: DataFrame) -> DataFrame:
    """(fingerprint, hash, ts, back): commits of ``history`` (file, hash, ts, back, old_blob, blob) that change how often a text occurs.

    ``needles``: fingerprint, file, needle. ``blobs``: blob, text. Commits are compared with what they change, whatever their order.
    """
    each = history.join(needles, "file")
    # a text is counted once in each blob
    asked = each.select("needle", F.explode(F.array("old_blob", "blob")).alias("_b")).distinct()
    n = asked.join(blobs, F.col("_b") == F.col("blob")).select(F.col("needle").alias("_needle"), "_b", occurrences(F.col("text"), F.col("needle")).alias("n"))
    n = saved(n.where("n > 0"))
    of = lambda x: n.select(F.col("_needle").alias(f"needle_{x}"), F.col("_b").alias(f"blob_{x}"), F.col("n").alias(f"n_{x}"))
    both = each.join(of("old"), (F.col("needle") == F.col("needle_old")) & (F.col("old_blob") == F.col("blob_old")), "left")
    both = both.join(of("new"), (F.col("needle") == F.col("needle_new")) & (F.col("blob") == F.col("blob_new")), "left")
    return both.where(F.coalesce("n_old", F.lit(0)) != F.coalesce("n_new", F.lit(0))).select("fingerprint", "hash", "ts", "back")


def introduced(found: DataFrame) -> DataFrame:
    """(fingerprint, introduced): the time of the oldest commit of ``pickaxe``."""
    return found.groupBy("fingerprint").agg(F.max_by("ts", "back").alias("introduced"))
