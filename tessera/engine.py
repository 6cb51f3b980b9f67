"""A whole analysis: files to nodes, rules, severities, fingerprints, suppression and baseline.

Files are rows of file_id, path, language and text. Besides C# and SQL, project files (language ``project``) and settings
files (``settings``) are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import packs as pk
from tessera import rules as known
from tessera.common import saved
from tessera.config import Config
from tessera.operators import code_rules as code
from tessera.operators import findings as fi
from tessera.operators import fused, graph
from tessera.parse import nodes as trees
from tessera.sources import files as src
from tessera.sources import projects as pr

#: Scopes of the rules that run in each mode.
MODES = {"file": ("file",), "project": ("file", "project"), "workspace": ("file", "project", "workspace")}

#: What all rules but those of packs read: ``fused`` asks for most, layers for the text of names, settings for arguments.
READS = replace(fused.READS, columns=(*fused.READS.columns, "text", "argument_kind"))


@dataclass
class Result:
    findings: DataFrame
    baselined: DataFrame
    skipped: DataFrame
    failed: list[tuple[str, str]]
    diagnostics: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Part:
    """Rules that one query answers; ``apart`` are queries for a rule or a few each, for when the one fails."""

    ids: tuple[str, ...]
    make: Callable[[], DataFrame]
    apart: tuple[Part, ...] = ()


def severities(spark: SparkSession, config: Config, packs: list[pk.Pack] = ()) -> DataFrame:
    table = [*known.TABLE, *(r for p in packs for r in p.rules)]
    categories = {r[1] for r in table}
    said = [("session", k, v) for k, v in config.session.items()]
    said += [("category" if k in categories else "rule", k, v) for k, v in config.rules.items()]
    rules = spark.createDataFrame(table, known.SCHEMA)
    return fi.effective_severities(rules, spark.createDataFrame(said, "scope string, key string, value string"))


def option(config: Config, rule: str, name: str, kind: type, default=None):
    """An option of a rule, or the default where it is missing or of another kind."""
    got = config.options.get(rule, {}) if isinstance(config.options.get(rule, {}), dict) else {}
    value = got.get(name, default)
    return value if isinstance(value, kind) and not isinstance(value, bool) else default


def pattern(config: Config, rule: str) -> str | None:
    """A pattern that compiles, or None."""
    text = option(config, rule, "pattern", str)
    try:
        re.compile(text or "")
    except re.error:
        return None
    return text


def names(value) -> list[str]:
    return value if isinstance(value, list) and all(isinstance(x, str) for x in value) else []


def at_start(files: DataFrame, rule: str, message) -> DataFrame:
    """A finding on the first line of each file."""
    said = F.lit(message) if isinstance(message, str) else message
    return files.select("file_id", F.lit(rule).alias("rule_id"), said.alias("message"), F.lit(0).alias("line"), F.lit(0).alias("col"))


def project_parts(files: DataFrame, tree: DataFrame) -> list[Part]:
    """AR0030 to AR0041, over project and settings files."""
    projects = files.where("language = 'project'")
    folders = projects.select(src.directory(F.col("path")).alias("project")).distinct()
    settings = saved(src.settings_files(files.where("language = 'settings'"), folders))
    read = saved(pr.parsed(projects.select("path", "text")))

    def keys() -> DataFrame:
        own = src.prefix_owner(files.where("language = 'csharp'").select("file_id", "path"), folders)
        leaves = src.json_leaves(settings.select("file_id", "text")).select(F.col("file_id").alias("_s"), F.col("path").alias("key"))
        by = settings.select("file_id", "project").join(leaves, F.col("file_id") == F.col("_s")).select("project", F.col("key").alias("path"))
        return code.unknown_keys(tree, own, by)

    def rings() -> DataFrame:
        known_only = pr.references(read).join(projects.select(F.col("path").alias("target")), "target", "left_semi")
        ring = graph.cycles(known_only.select(F.col("target").alias("callee"), F.col("project").alias("caller")))
        said = F.concat(F.lit("project is on a cycle of "), "size", F.lit(" with '"), "component", F.lit("'"))
        return at_start(projects.join(ring, F.col("path") == F.col("node")), "AR0040", said)

    return [
        Part(("AR0030",), keys),
        Part(("AR0031",), lambda: at_start(src.malformed(settings), "AR0031", "settings file can't be read")),
        Part(("AR0040",), rings),
        Part(("AR0041",), lambda: at_start(projects.join(read.where("error is not null").select("path"), "path", "left_semi"), "AR0041", "project file can't be read")),
    ]


def file_parts(tree: DataFrame, config: Config, active: Collection[str]) -> Part:
    """Rules that look at one C# file after the other: all that are active in one scan."""
    singles = tuple(sorted({r for r, _, _ in code.predicates()}))
    hosts = names(option(config, "SVC0010", "allowedHosts", list, []))
    plain = {
        code.async_void: ("AR0012",), code.rethrow: ("AR0014",), code.count_compared: ("AR0020",), code.concat_in_loop: ("AR0021",), code.culture_case: ("AR0090",), code.weak_random: ("AR0052",),
        code.nested_quantifiers: ("AR0053",), code.unused_parameters: ("AR0070",), code.unused_locals: ("AR0071",), code.undisposed: ("AR0074",), code.public_fields: ("AR0075",), code.async_names: ("SVC0020",),
    }
    threshold, length, occurrences = option(config, "AR0060", "threshold", int, 15), option(config, "AR0061", "minLength", int, 10), option(config, "AR0061", "minOccurrences", int, 3)
    apart = [Part(ids, lambda f=f: f(tree)) for f, ids in plain.items()]
    apart += [
        Part(singles, lambda: code.single_node(tree, hosts)),
        Part(("AR0060",), lambda: code.too_complex(tree, threshold)),
        Part(("AR0061",), lambda: code.duplicate_literals(tree, length, occurrences)),
    ]
    wanted = tuple(r for r in fused.RULES if r in active)
    return Part(fused.RULES, lambda: fused.findings(tree, wanted, hosts, threshold, length, occurrences), tuple(apart))


def parts(files: DataFrame, tree: DataFrame, items: DataFrame, config: Config, packs: list[pk.Pack], active: Collection[str]) -> list[Part]:
    literals, embedded = code.embedded_sql(tree, trees.items_of)
    out = [
        file_parts(tree, config, active),
        Part(("AR0002", "AR0003", "AR0004", "AR0005"), lambda: code.captive(tree)),
        Part(("AR0023",), lambda: code.inline_star(literals, embedded)),
        Part(("AR0080",), lambda: code.unknown_columns(literals, embedded, code.catalog(items))),
        Part(tuple(r[0] for r in known.TABLE if r[0].startswith("SQ")), lambda: code.sql_rules(items, option(config, "SQ0010", "policy", str), pattern(config, "SQ0011"), pattern(config, "SQ0012"))),
    ]
    forbidden = config.options.get("ACME0002", {}).get("namespaces") if isinstance(config.options.get("ACME0002"), dict) else None
    if names(forbidden):
        out.append(Part(("ACME0002",), lambda: code.forbidden_namespaces(tree, forbidden)))
    elif forbidden is not None and forbidden != []:
        out.append(Part(("ACME0003",), lambda: at_start(files.where("language = 'csharp'"), "ACME0003", "namespaces is not a list of names")))
    if config.layers.get("layers"):
        flat = [(p, layer, i) for i, (layer, ps) in enumerate(config.layers["layers"].items()) for p in ps]
        allow = "allow" in config.layers
        edges = [(e["from"], e["to"]) for e in config.layers.get("allow" if allow else "deny", [])]
        out.append(Part(("AR0001",), lambda: code.layers(tree, files.sparkSession.createDataFrame(flat, "prefix string, layer string, ord int"), edges, allow)))
    out += project_parts(files, tree)
    return out + [Part(tuple(r[0] for r in p.rules), lambda p=p: p.find(tree, items, config.options).select("file_id", "rule_id", "message", "line", "col")) for p in packs]


def ran(chosen: list[Part], empty: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(file_id, rule_id, message, line, col) of all parts in one job; if that fails, part by part, without those that fail.

    A finding whose id its part doesn't declare is dropped.
    """
    made, failed = [], []
    for p in chosen:
        try:
            made.append((p, p.make().where(F.col("rule_id").isin(*p.ids))))
        except Exception as e:  # one rule's failure leaves the others
            failed.append((", ".join(p.ids), str(e)))
    union = empty
    for _, found in made:
        union = union.unionByName(found)
    try:
        return saved(union), failed
    except Exception:  # a rule failed on the executors: find out which
        union = empty
        for p, found in made:
            try:
                union = union.unionByName(saved(found))
            except Exception as e:
                if p.apart:
                    some, why = ran([of(x, p.ids) for x in p.apart if set(x.ids) & set(p.ids)], empty)
                    union, failed = union.unionByName(some), failed + why
                else:
                    failed.append((", ".join(p.ids), str(e).split("\n")[0]))
        return union, failed


def of(part: Part, active: Collection[str]) -> Part:
    """``part`` for the active ones of its rules."""
    return replace(part, ids=tuple(i for i in part.ids if i in active))


def check(files: DataFrame, config: Config | None = None, baseline: DataFrame | None = None, mode: str = "workspace", target: str | None = None) -> Result:
    """``mode`` is file, project or workspace; for the first two, ``target`` is the path of a file.

    In project mode the target's project is looked at, and rules on single files tell of the target alone, unless the
    project doesn't hold it.
    """
    config = config or Config()
    spark = files.sparkSession
    files = files.where(src.not_excluded(F.col("path"), [*src.DEFAULT_EXCLUDES, *config.exclude]))
    packs, messages = pk.load(config.rule_packs, [r[0] for r in known.TABLE])
    table = saved(severities(spark, config, packs).where(F.col("scope").isin(*MODES[mode])))
    active = {r.rule_id: r.scope for r in table.where("severity <> 'off'").select("rule_id", "scope").collect()}
    alone = None
    if mode == "file":
        files = src.single_file(files, target)
    elif mode == "project":
        folder = src.project_of(files, target)
        files = files.where(F.lit(folder == "") | F.col("path").startswith(f"{folder}/"))
        alone = src.single_file(files, target)
        alone = None if alone.isEmpty() else alone
    # packs may ask for any column, rules of our own for some
    tree = trees.tree_of(files.where("language = 'csharp'"), None if packs else READS)
    items = trees.items_of(files.where("language = 'sql'"))
    chosen = [p for p in (of(p, active) for p in parts(files, tree, items, config, packs, active)) if p.ids]
    raw, failed = ran(chosen, spark.createDataFrame([], "file_id long, rule_id string, message string, line int, col int"))
    if alone is not None:
        single = F.col("rule_id").isin(*(i for i, scope in active.items() if scope == "file"))
        raw = raw.where(~single).unionByName(raw.where(single).join(alone.select("file_id"), "file_id", "left_semi"))
    found = fi.stamped(raw.distinct(), table).join(files.select("file_id", "path"), "file_id")
    marked = src.lines(files.where(F.lower("text").contains(fi.MARKER)))
    found = fi.unsuppressed(fi.fingerprinted(fi.anchored(found, files)), fi.suppressions(marked))
    why = spark.createDataFrame([(i, f"failed: {e}") for ids, e in failed for i in ids.split(", ")], "rule_id string, reason string")
    skipped = fi.skipped(table).unionByName(why)
    messages = [*config.messages, *messages]
    if baseline is None:
        return Result(found, found.limit(0), skipped, failed, messages)
    new, old = fi.split_by_baseline(found, baseline)
    return Result(new, old, skipped, failed, messages)
