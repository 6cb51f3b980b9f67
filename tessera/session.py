"""A session over one workspace: what an editor or a script asks again and again, as methods and as JSON lines."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config as cfg
from tessera import engine
from tessera import rules as known
from tessera.common import saved, shared_path
from tessera.operators import graph, impact, reports
from tessera.parse.tsql_format import formatted
from tessera.sources import files as src
from tessera.streaming.incremental import overlaid
from tessera.streaming.store import Store, of_code

METHODS = "initialize listRules analyzeFile analyzeWorkspace formatFile methodImpact methodTrace setSeverity invalidate reloadConfig writeBaseline shutdown".split()


class Session:
    """Unsaved texts lie over the files; members and calls lie in a store, in which only changed files are parsed again;
    severities that are set here outlive a reload of the settings."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.texts: dict[str, str] = {}
        self.severities: dict[str, str] = {}
        self.kept: dict[str, DataFrame] = {}
        self.store = Store(spark, shared_path(spark), of_code())
        self.reload_config()

    def reload_config(self) -> list[str]:
        self.config = cfg.load(self.root)
        self.config.session = self.severities
        return self.config.messages

    def files(self) -> DataFrame:
        if "files" not in self.kept:
            found = src.read_workspace(self.spark, str(Path(self.root).resolve()), tuple(self.config.exclude))
            if self.texts:
                rows = self.spark.createDataFrame(list(self.texts.items()), "path string, text string")
                rows = rows.select(F.xxhash64("path").alias("file_id"), "path", src.language(F.col("path")).alias("language"), "text")
                found = overlaid(found, rows)
            self.kept["files"] = saved(found)
        return self.kept["files"]

    def invalidate(self, path: str | None = None, text: str | None = None) -> None:
        """Forgets what was read; with a text, that stands for the file until it is forgotten by path alone."""
        if path is not None:
            self.texts.pop(path, None)
            if text is not None:
                self.texts[path] = text
        self.kept.clear()

    def set_severity(self, rule: str, severity: str) -> None:
        self.severities[rule] = severity

    def list_rules(self) -> list[dict]:
        rows = engine.severities(self.spark, self.config).orderBy("rule_id").collect()
        return [{"id": r.rule_id, "category": r.category, "severity": r.severity, "scope": r.scope, "title": r.title} for r in rows]

    def baseline(self) -> DataFrame | None:
        rows, _ = cfg.read_baseline(Path(self.root) / (self.config.baseline or cfg.BASELINE))
        return self.spark.createDataFrame([(x,) for x in rows], "fingerprint string") if rows else None

    def analyze(self, mode: str = "workspace", path: str | None = None) -> dict:
        out = engine.check(self.files(), self.config, self.baseline(), mode, path)
        return reports.reply(out.findings, out.baselined.count(), out.failed)

    def write_baseline(self) -> int:
        out = engine.check(self.files(), self.config)
        rows = [r.value for r in reports.baseline_rows(out.findings).toLocalIterator()]
        (Path(self.root) / (self.config.baseline or cfg.BASELINE)).write_text("[" + ",\n ".join(rows) + "]\n", encoding="utf-8")
        return len(rows)

    def format_file(self, path: str) -> str | None:
        row = src.single_file(self.files(), path).first()
        return formatted(row.text) if row else None

    def calls(self) -> tuple[DataFrame, DataFrame]:
        """Members with their place and project, and call edges."""
        if "members" not in self.kept:
            files = self.files()
            self.store.sync(files.where("language = 'csharp'"))
            folders = files.where("language = 'project'").select(src.directory(F.col("path")).alias("project")).distinct()
            own = src.prefix_owner(files.select("file_id", "path"), folders)
            place = files.select("file_id", "path").join(own, "file_id", "left").select(F.col("file_id").alias("_f"), "path", F.coalesce("project", src.directory(F.col("path"))).alias("project"))
            self.kept["members"] = saved(self.store.table("members").join(place, F.col("file_id") == F.col("_f")).drop("_f"))
            self.kept["edges"] = self.store.table("edges")
        return self.kept["members"], self.kept["edges"]

    def method_impact(self, path: str, depth: int = 6, callers: int = 50) -> list[dict]:
        members, edges = self.calls()
        mine = members.where(F.lower("path") == path.lower())
        rows = impact.impact(mine, members, edges, depth).withColumn("label", impact.label())
        rows = rows.join(mine.select("file_id", "node", "line", "col"), ["file_id", "node"]).orderBy("line", "col").collect()
        first = impact.first_callers(impact.callers(members, edges).join(mine.select(F.col("key").alias("callee")).distinct(), "callee", "left_semi"), callers)
        of: dict[str, list] = {}
        for r in first.orderBy("callee", "place").collect():
            of.setdefault(r.callee, []).append({"file": r.path, "line": r.line, "column": r.col, "isTest": r.is_test})
        return [{"key": r.key, "line": r.line, "callers": r.n_callers, "projects": r.n_projects, "tests": r.n_tests, "bounded": r.bounded, "label": r.label, "callerList": of.get(r.key, [])} for r in rows]

    def method_trace(self, path: str, line: int, depth: int = 6, nodes: int = 60) -> dict | None:
        members, edges = self.calls()
        root = members.where((F.lower("path") == path.lower()) & (F.col("line") == line)).orderBy("col").first()
        if root is None:
            return None
        rows = graph.trace(root.key, edges, members, depth, nodes)
        many = graph.ambiguous(members)
        return {"root": root.key, "edges": [{"from": r.caller, "to": r.callee} for r in rows.orderBy("callee", "caller").collect()], "diagram": reports.mermaid(root.key, rows, many)}

    def answer(self, method: str, p: dict) -> object:
        does: dict[str, Callable[[], object]] = {
            "initialize": lambda: {"root": self.root, "messages": self.config.messages},
            "listRules": self.list_rules,
            "analyzeFile": lambda: (self.invalidate(p["path"], p["text"]) if "text" in p else None, self.analyze(p.get("mode", "file"), p["path"]))[1],
            "analyzeWorkspace": self.analyze,
            "formatFile": lambda: self.format_file(p["path"]),
            "methodImpact": lambda: self.method_impact(p["path"], p.get("depth", 6), p.get("callers", 50)),
            "methodTrace": lambda: self.method_trace(p["path"], p["line"], p.get("depth", 6), p.get("nodes", 60)),
            "setSeverity": lambda: self.set_severity(p["rule"], p["severity"]),
            "invalidate": lambda: self.invalidate(p.get("path"), p.get("text")),
            "reloadConfig": self.reload_config,
            "writeBaseline": self.write_baseline,
        }
        return does[method]()

    def serve(self, requests: TextIO, replies: TextIO) -> None:
        """A request {id, method, params} a line, and a reply {id, result or error} for each, until shutdown or the end."""
        for line in requests:
            number, stop = None, False
            try:
                said = json.loads(line)
                number, method = said.get("id"), said.get("method")
                stop = method == "shutdown"
                if method not in METHODS:
                    raise ValueError(f"unknown method '{method}'" + cfg.did_you_mean(str(method), METHODS))
                out = {"id": number, "result": None if stop else self.answer(method, said.get("params") or {})}
            except Exception as e:  # a request that fails leaves the session
                out = {"id": number, "error": f"{type(e).__name__}: {e}"}
            replies.write(json.dumps(out) + "\n")
            replies.flush()
            if stop:
                return
