import builtins
import os

import pytest

from tessera.sources import files as src
from tessera.sources import walk

TREE = {
    "a/x.cs": "class X { }", "a/bin/y.cs": "class Y { }", "a/b/z.SQL": "SELECT 1", "a/b/gen/deep/w.cs": "class W { }", "a/a.csproj": "<Project />", "a/appsettings.Test.json": "{}", "a/other.json": "{}",
    "node_modules/m.cs": "class M { }", "top.cs": "﻿class T { }", "readme.md": "# no", "obj/o.sql": "SELECT 2",
}


@pytest.fixture
def root(tmp_path):
    for path, text in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    os.symlink(tmp_path / "a", tmp_path / "link")
    return str(tmp_path)


def test_what_is_read(spark, root):
    got = {(r.path, r.language, r.text) for r in src.read_workspace(spark, root, ("**/gen/**",)).collect()}
    assert got == {("a/x.cs", "csharp", "class X { }"), ("a/b/z.SQL", "sql", "SELECT 1"), ("a/a.csproj", "project", "<Project />"), ("a/appsettings.Test.json", "settings", "{}"), ("top.cs", "csharp", "class T { }")}
    assert {r.path for r in src.read_workspace(spark, root).where("language = 'csharp'").collect()} == {"a/x.cs", "a/b/gen/deep/w.cs", "top.cs"}
    assert {r.path for r in src.read_workspace(spark, root).where("language in ('sql', 'project')").collect()} == {"a/b/z.SQL", "a/a.csproj"}
    # a store that Spark alone reads gives the same; it has no links
    os.unlink(f"{root}/link")
    same = lambda df: {(r.path, r.language, r.text) for r in df.collect()}
    assert same(src.stored_workspace(spark, f"file://{root}")) == same(src.read_workspace(spark, root)) == same(src.read_workspace(spark, f"file://{root}"))


def test_one_file_and_the_projects_below_its_folder(spark, root):
    assert {r.path for r in src.read_workspace(spark, f"{root}/a/x.cs").collect()} == {"x.cs", "a.csproj", "appsettings.Test.json"}


def test_excluded_folders_are_not_listed_and_excluded_files_not_opened(root, monkeypatch):
    listed, opened = [], []
    monkeypatch.setattr(os, "scandir", lambda p, f=os.scandir: listed.append(os.path.relpath(p, root)) or f(p))
    monkeypatch.setattr(builtins, "open", lambda p, *a, f=open, **k: opened.append(os.path.relpath(p, root)) or f(p, *a, **k))
    reader = walk.Reader(root, [*src.DEFAULT_EXCLUDES, "**/gen/**"])
    assert list(reader.pushFilters([walk.EqualTo(("language",), "csharp"), walk.EqualTo(("path",), "x")])) == [walk.EqualTo(("path",), "x")]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(listed) == [".", "a", "a/b"]
    assert sorted(opened) == sorted(r[0] for r in rows) == ["a/x.cs", "top.cs"]


def test_places_that_can_not_be_read_are_told(root, monkeypatch):
    def scandir(path, f=os.scandir):
        if str(path).endswith("/b"):
            raise PermissionError(13, "Permission denied")
        return f(path)

    monkeypatch.setattr(os, "scandir", scandir)
    reader = walk.Reader(root, list(src.DEFAULT_EXCLUDES))
    tasks = reader.partitions()
    monkeypatch.setattr(builtins, "open", lambda p, *a, f=open, **k: f(p, *a, **k) if "top" not in str(p) else (_ for _ in ()).throw(PermissionError(13, "Permission denied")))
    rows = [r for p in tasks for r in reader.read(p)]
    assert {(r[0], r[3]) for r in rows if r[3]} == {("a/b", "Permission denied"), ("top.cs", "Permission denied")}
    assert {r[0] for r in rows if not r[3]} == {"a/x.cs", "a/a.csproj", "a/appsettings.Test.json"}


def test_problems_as_rows(spark, root):
    assert src.unreadable(spark, root).count() == 0
    assert [r.path for r in src.unreadable(spark, f"{root}/missing").collect()] == ["."]


def test_files_are_dealt_out_by_size(root, monkeypatch):
    monkeypatch.setattr(walk, "TASK_BYTES", 15)
    tasks = walk.Reader(root, list(src.DEFAULT_EXCLUDES)).partitions()
    assert len(tasks) > 2 and sum(len(t.files) for t in tasks) == 6
