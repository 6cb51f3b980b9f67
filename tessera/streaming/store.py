"""Tables of parsed files that follow their files: edits, deletions, renames and replayed batches.

Everything that is made of a file (its nodes, its members, its call edges) lies in a bucket by the file's id. A change
reads the buckets of the changed files, leaves out what was made of them before, adds what is made of them now, and writes
those buckets as a new *generation*; the others stay. A manifest says which generation each bucket is of. It is written last,
so that a reader sees all of a change or nothing, and a change that fails half way is as if it had not been.

    files/g=3/b=7/      (path, file_id, language, version) of the files that there are
    nodes/g=3/b=7/      and so on for each table
    manifest/n=3/       (bucket, generation, batch)

Versions are hashes of path and text: a file whose content is as before is neither parsed nor moved. A batch is known by its
number; one that has been applied does nothing when it comes again. Generations that no manifest names any more are
deleted, but for those of the manifest before, which readers may still hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import saved

FILES = "path string, file_id long, language string, version long"
MANIFEST = "bucket int, generation long, batch long"


class Store:
    """``tables``: what is made of files (file_id, path, language, text), by name; each has a ``file_id``. A table may also be made
    of one before it, which is given as its second argument: see ``of_code``."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]], buckets: int = 64):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.buckets = buckets
        probe = spark.createDataFrame([], "file_id long, path string, language string, text string")
        made: dict[str, DataFrame] = {}
        for name, make in tables.items():
            made[name] = make(probe, made)
        self.schemas = {name: df.schema for name, df in made.items()} | {"files": spark.createDataFrame([], FILES).schema}

    # --- the manifest

    def _fs(self):
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        return home.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        """Complete manifests, oldest first."""
        fs, path = self._fs()
        home = path(f"{self.path}/manifest")
        if not fs.exists(home):
            return []
        found = [s.getPath() for s in fs.listStatus(home)]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("n=") and fs.exists(path(f"{p}/_SUCCESS")))

    def manifest(self) -> tuple[int, dict[int, int], int]:
        """(number, generation by bucket, last batch); a row for each bucket."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}, -1
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/n={numbers[-1]}").collect()
        return numbers[-1], {r.bucket: r.generation for r in rows if r.bucket >= 0}, max(r.batch for r in rows)

    # --- reading

    def _read(self, name: str, generations: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/{name}/g={g}/b={b}" for b, g in sorted(generations.items())]
        fs, path = self._fs()
        paths = [p for p in paths if fs.exists(path(p))]  # a bucket without rows has no folder
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def table(self, name: str) -> DataFrame:
        """What is made of the files that there are now; ``files`` tells which."""
        return self._read(name, self.manifest()[1])

    # --- writing

    def bucket(self, file_id: Column) -> Column:
        return F.pmod(F.xxhash64(file_id), F.lit(self.buckets)).cast("int")

    def sync(self, files: DataFrame, batch: int | None = None) -> int:
        """Makes the tables those of ``files`` (file_id, path, language, text), all there are. Returns the number of changed files."""
        number, generations, last = self.manifest()
        if batch is not None and batch <= last:
            return 0
        now = versioned(files)
        known = self._read("files", generations).select(F.col("file_id").alias("_id"), F.col("version").alias("_version"))
        both = now.select("file_id", "version").join(known, F.col("file_id") == F.col("_id"), "full")
        changed = saved(both.where(~F.col("version").eqNullSafe(F.col("_version"))).select(F.coalesce("file_id", "_id").alias("file_id")))
        return self._rewrite(now, changed, number, generations, last if batch is None else batch)

    def apply(self, changes: DataFrame, batch: int) -> int:
        """Applies ``changes`` (file_id, path, language, text): a null text deletes. Of several of one file the last by ``seq`` counts,
        if there is such a column. A batch that was applied before changes nothing."""
        number, generations, last = self.manifest()
        if batch <= last:
            return 0
        order = F.col("seq") if "seq" in changes.columns else F.xxhash64("path", "text")
        latest = changes.groupBy("file_id").agg(F.max_by(F.struct("path", "language", "text"), order).alias("x")).select("file_id", "x.*")
        latest = versioned(saved(latest))
        known = self._read("files", generations).select(F.col("file_id").alias("_id"), F.col("version").alias("_version"))
        both = latest.join(known, F.col("file_id") == F.col("_id"), "left")
        differs = F.when(F.col("text").isNull(), F.col("_id").isNotNull()).otherwise(~F.col("version").eqNullSafe(F.col("_version")))
        changed = saved(both.where(differs).select("file_id"))
        return self._rewrite(latest.where("text is not null"), changed, number, generations, batch)

    def _rewrite(self, now: DataFrame, changed: DataFrame, number: int, generations: dict[int, int], batch: int) -> int:
        """``now``: files with their versions; those in ``changed`` (file_id) have other rows than before, or none."""
        counts = changed.groupBy(self.bucket(F.col("file_id")).alias("b")).count().collect()  # a row for each bucket
        touched = {r.b for r in counts}
        if touched:
            ids = changed.select(F.col("file_id").alias("_changed"))
            new = saved(now.join(ids, F.col("file_id") == F.col("_changed"), "left_semi"))
            before = {b: g for b, g in generations.items() if b in touched}
            made = {"files": new.select("path", "file_id", "language", "version")}
            for name, make in self.tables.items():
                made[name] = make(new.select("file_id", "path", "language", "text"), made)
                self._write(name, made[name], before, ids, number + 1)
            self._write("files", made["files"], before, ids, number + 1)
        generations = generations | dict.fromkeys(touched, number + 1)
        rows = [(b, g, batch) for b, g in generations.items()] + [(-1, -1, batch)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/n={number + 1}")
        self._forget(number)
        return sum(r["count"] for r in counts)

    def _write(self, name: str, made: DataFrame, before: dict[int, int], ids: DataFrame, generation: int) -> None:
        left = self._read(name, before).join(ids, F.col("file_id") == F.col("_changed"), "left_anti")
        rows = left.unionByName(made).withColumn("b", self.bucket(F.col("file_id")))
        order = [c for c in ("file_id", "node") if c in made.columns]
        # a run that broke off may have left something under this number
        rows.repartition("b").sortWithinPartitions("b", *order).write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/{name}/g={generation}")

    def _forget(self, keep_from: int) -> None:
        """Deletes manifests before ``keep_from``, and the buckets that none of the others names."""
        fs, path = self._fs()
        numbers = self._numbers()
        named: set[tuple[int, int]] = set()
        for n in numbers:
            if n < keep_from:
                fs.delete(path(f"{self.path}/manifest/n={n}"), True)
            else:
                named |= {(r.generation, r.bucket) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/n={n}").collect()}
        alive = {g for g, _ in named}
        for name in self.schemas:
            home = path(f"{self.path}/{name}")
            for g in fs.listStatus(home) if fs.exists(home) else []:
                number = int(g.getPath().getName()[2:])
                if number not in alive:
                    fs.delete(g.getPath(), True)
                    continue
                for b in fs.listStatus(g.getPath()):
                    bucket = b.getPath().getName()
                    if bucket.startswith("b=") and (number, int(bucket[2:])) not in named:
                        fs.delete(b.getPath(), True)


def versioned(files: DataFrame) -> DataFrame:
    return files.select("file_id", "path", "language", "text").withColumn("version", F.xxhash64("path", "language", "text"))


def of_code() -> dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]]:
    """Nodes, members and call edges of C# files, items of SQL files."""
    from tessera.common import by_file
    from tessera.operators import code_rules
    from tessera.parse import nodes

    return {
        "nodes": lambda files, made: saved(nodes.csharp_nodes(by_file(files.where("language = 'csharp'")))),
        "members": lambda files, made: code_rules.members(made["nodes"]),
        "edges": lambda files, made: code_rules.call_edges(made["nodes"]),
        "items": lambda files, made: nodes.sql_items(by_file(files.where("language = 'sql'"))),
    }


def followed(spark: SparkSession, source: str, store: Store, checkpoint: str, schema: str = "file_id long, path string, language string, text string, seq long"):
    """A stream that applies the changes that arrive in ``source`` (Parquet) to ``store``.

    A batch that is run again after a failure has its number, so that it is applied once.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, number: store.apply(df, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
