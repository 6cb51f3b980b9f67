"""The files below a folder as a data source of Spark.

The planner walks the folders once: excluded folders are left out before they are listed, links aren't followed, and
what can't be listed becomes a row with a ``problem``. Files are dealt out by size, whole folders together, and a filter on
``language`` or ``problem`` is taken over before that. Only then, in the tasks, are the files opened.

The tasks open the files by path, so that on a cluster the folder has to be one that all executors see.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

NAME = "tessera_workspace"
#: Bytes and files of a task.
TASK_BYTES, TASK_FILES = 8 << 20, 2048


@dataclass
class Task(InputPartition):
    #: (path below the root, language), and (path, problem) of what can't be read
    files: list[tuple[str, str]]
    problems: list[tuple[str, str]]


def language_of(path: str) -> str | None:
    """csharp, sql, project, settings or None: the same as ``files.language``."""
    from tessera.sources.files import LANGUAGES

    low = path.lower()
    for ending, name in LANGUAGES.items():
        if low.endswith(ending):
            return name
    return "settings" if re.search(r"(^|/)appsettings[^/]*\.json$", low) else None


def excluded(globs: Iterable[str]):
    """A test of a path below the root; folders are asked with a slash at their end."""
    from tessera.sources.files import glob_regex

    tests = [re.compile(glob_regex(g.strip())) for g in globs if g.strip()]
    return lambda path: any(t.match(path) for t in tests)


class Reader(DataSourceReader):
    def __init__(self, root: str, globs: list[str]):
        self.root, self.globs = root, globs
        self.languages: set[str] | None = None
        self.with_files = self.with_problems = True

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == ("language",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("language",):
                self._only(set(f.value))
            elif isinstance(f, IsNotNull) and f.attribute == ("language",):
                self.with_problems = False
            elif isinstance(f, IsNull) and f.attribute == ("problem",):
                self.with_problems = False
            elif isinstance(f, IsNotNull) and f.attribute == ("problem",):
                self.with_files = False
            else:
                yield f

    def _only(self, languages: set) -> None:
        self.languages = languages if self.languages is None else self.languages & languages
        self.with_problems = False

    def walk(self) -> Iterator[tuple[str, str | None, int, str | None]]:
        """(path, language, size, problem) of a folder's sources; of a file and the projects and settings below its folder."""
        alone = None
        root = self.root
        if os.path.isfile(root):
            root, alone = os.path.split(root)
        out = excluded(self.globs)
        stack = [""]
        while stack:
            folder = stack.pop()
            try:
                with os.scandir(os.path.join(root, folder)) as listed:
                    entries = sorted(listed, key=lambda e: e.name)
            except OSError as e:
                yield folder or ".", None, 0, e.strerror or type(e).__name__
                continue
            below = []
            for entry in entries:
                path = f"{folder}/{entry.name}" if folder else entry.name
                try:
                    if entry.is_symlink():
                        continue
                    if entry.is_dir():
                        if not out(path + "/"):
                            below.append(path)
                        continue
                    kind = language_of(path)
                    if kind and not out(path) and (alone is None or path == alone or kind in ("project", "settings")):
                        yield path, kind, entry.stat().st_size, None
                except OSError as e:
                    yield path, None, 0, e.strerror or type(e).__name__
            stack += reversed(below)

    def partitions(self) -> list[InputPartition]:
        tasks, files, problems, held = [], [], [], 0
        for path, kind, size, problem in self.walk():
            if problem is not None:
                problems.append((path, problem))
            elif self.with_files and (self.languages is None or kind in self.languages):
                files.append((path, kind))
                held += size
                if held >= TASK_BYTES or len(files) >= TASK_FILES:
                    tasks.append(Task(files, []))
                    files, held = [], 0
        return [*tasks, Task(files, problems)]

    def read(self, partition: Task) -> Iterator[tuple]:
        if self.with_problems:
            for path, why in partition.problems:
                yield path, None, None, why
        root = os.path.dirname(self.root) if os.path.isfile(self.root) else self.root
        for path, kind in partition.files:
            try:
                with open(os.path.join(root, path), "rb") as f:
                    text = f.read().decode("utf-8", "replace").removeprefix("﻿")
            except FileNotFoundError:  # it went meanwhile
                continue
            except OSError as e:
                if self.with_problems:
                    yield path, None, None, e.strerror or type(e).__name__
                continue
            yield path, kind, text, None


class Workspace(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, language string, text string, problem string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["root"], json.loads(self.options.get("exclude", "[]")))


def walked(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """(path, language, text, problem): a row for each source that can be read, and one for each place that can't."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workspace)
    return spark.read.format(NAME).option("root", root).option("exclude", json.dumps(list(globs))).load()
