"""Findings as text, JSON, SARIF and a baseline file.

Rows become JSON inside Spark; the driver writes them one by one in report order, so that it holds no more than a
partition of a report at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.findings import SEVERITIES, at_least, report_order

SARIF_LEVELS = {"error": "error", "warning": "warning", "information": "note", "hint": "note"}


def json_rows(findings: DataFrame) -> DataFrame:
    """(value): a JSON object for each finding, in report order; lines from 0."""
    one = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "message", F.col("path").alias("file"), F.col("line").alias("startLine"), "severity", "category", "fingerprint"))
    return findings.orderBy(*report_order()).select(one.alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(value): a SARIF result for each finding; lines from 1."""
    level = F.coalesce(*(F.when(F.col("severity") == k, F.lit(v)) for k, v in SARIF_LEVELS.items()))
    region = F.struct((F.col("line") + 1).alias("startLine"), (F.col("col") + 1).alias("startColumn"))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    prints = F.struct(F.col("fingerprint").alias("primaryLocationLineHash"))
    one = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), prints.alias("partialFingerprints"))
    return findings.orderBy(*report_order()).select(F.to_json(one).alias("value"))


def sarif(findings: DataFrame, titles: dict[str, str], tool: str = "tessera") -> Iterator[str]:
    """A SARIF 2.1.0 log in pieces."""
    used = sorted(r.rule_id for r in findings.select("rule_id").distinct().collect())
    driver = {"name": tool, "rules": [{"id": u, "shortDescription": {"text": titles.get(u, u)}} for u in used]}
    yield '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":' + json.dumps(driver) + '},"results":['
    for i, r in enumerate(sarif_results(findings).toLocalIterator()):
        yield ("," if i else "") + r.value
    yield "]}]}"


def by_file(findings: DataFrame) -> DataFrame:
    """(path, n, errors, warnings, lower, rows): a row for each file, its findings in order."""
    level = lambda *names: F.count_if(F.col("severity").isin(*names))
    rows = F.sort_array(F.collect_list(F.struct("line", "rule_id", "message", "severity"))).alias("rows")
    return findings.groupBy("path").agg(F.count("*").alias("n"), level("error").alias("errors"), level("warning").alias("warnings"), level("information", "hint").alias("lower"), rows)


def console(findings: DataFrame, n_baselined: int, failed: list[tuple[str, str]] = ()) -> Iterator[str]:
    totals = [0, 0, 0]
    for f in by_file(findings).orderBy(F.upper("path"), "path").toLocalIterator():
        yield f.path
        for r in f.rows:
            yield f"  {r.line + 1}: {r.severity} {r.rule_id} {r.message}"
        totals = [a + b for a, b in zip(totals, (f.errors, f.warnings, f.lower), strict=True)]
    yield f"{totals[0]} errors, {totals[1]} warnings, {totals[2]} others; {n_baselined} accepted before"
    yield from (f"rule {r} failed: {why}" for r, why in failed)


def baseline_rows(findings: DataFrame) -> DataFrame:
    """What a baseline keeps of findings: sorted by file, rule, fingerprint."""
    one = F.to_json(F.struct("fingerprint", F.col("rule_id").alias("ruleId"), F.col("path").alias("file"), "message"))
    return findings.select("path", "rule_id", "fingerprint", one.alias("value")).orderBy("path", "rule_id", "fingerprint").select("value")


def exit_code(findings: DataFrame, fail_on: str = "error") -> int:
    return int(fail_on in SEVERITIES and not at_least(findings, fail_on).isEmpty())


def report(findings: DataFrame, baselined: DataFrame, skipped: DataFrame, diagnostics: list[str]) -> Iterator[str]:
    """The whole JSON report in pieces; lines from 0."""
    counts = {r.severity: r.n for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    for i, (name, rows) in enumerate((("findings", json_rows(findings)), ("baselined", json_rows(baselined)))):
        yield ("," if i else "{") + f'"{name}":['
        for k, r in enumerate(rows.toLocalIterator()):
            yield ("," if k else "") + r.value
        yield "]"
    off = [{"ruleId": r.rule_id, "reason": r.reason} for r in skipped.orderBy("rule_id", "reason").collect()]
    yield f',"skipped":{json.dumps(off)},"diagnostics":{json.dumps(diagnostics)},"counts":{json.dumps({k: counts.get(k, 0) for k in reversed(SEVERITIES[1:])})}}}\n'


def reply(findings: DataFrame, n_baselined: int, failed: list[tuple[str, str]]) -> dict:
    """What a session answers: findings, how many are accepted, and the rules that failed."""
    return {"findings": [json.loads(r.value) for r in json_rows(findings).toLocalIterator()], "baselinedCount": n_baselined, "failed": [{"ruleId": r, "reason": why} for r, why in failed]}


def rules_tree(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """(category, total, enabled, n_findings, rules): categories with their rules (id, severity, n) in order."""
    n = findings.groupBy(F.col("rule_id").alias("_r")).agg(F.count("*").alias("n"))
    each = rules.join(n, F.col("rule_id") == F.col("_r"), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    listed = F.sort_array(F.collect_list(F.struct("rule_id", "severity", "n"))).alias("rules")
    return each.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("severity") != "off").alias("enabled"), F.sum("n").alias("n_findings"), listed)


def with_patterns(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Findings with the ``pattern`` that ``catalog`` (rule_id, pattern) points to, or null."""
    return findings.join(catalog.select(F.upper("rule_id").alias("_r"), "pattern"), F.upper("rule_id") == F.col("_r"), "left").drop("_r")


def explained(findings: DataFrame, explain=None) -> DataFrame:
    """Findings with ``explanation``: what ``explain`` (of rule id, message and line) gives, null without one. Detection never asks it."""
    said = explain(F.col("rule_id"), F.col("message"), F.col("anchor")) if explain else F.lit(None).cast("string")
    return findings.withColumn("explanation", said)


def suggested_fix(rule: Column, text: Column) -> Column:
    """A line rewritten for AR0020 (emptiness by Any) and AR0022 (no list in between), or null where nothing fits."""
    some = F.regexp_replace(text, r"\.Count\(\)\s*(?:>\s*0|!=\s*0|>=\s*1)(?![0-9.])", ".Any()")
    none = F.regexp_replace(some, r"(?<![\w.)\]])([\w.]+(?:\([^()]*\))?(?:\.\w+(?:\([^()]*\))?)*?)\.Count\(\)\s*==\s*0(?![0-9.])", "!$1.Any()")
    direct = F.regexp_replace(text, r"\.(?:ToList|ToArray)\(\)(?=\.\w+\()", "")
    out = F.when(rule == "AR0020", none).when(rule == "AR0022", direct)
    return F.when(out != text, out)


def mermaid(root: str, edges: DataFrame, ambiguous: DataFrame) -> str:
    """A call trace (callee, caller; bounded by its number of nodes) as a diagram: callers point to what they call."""
    rows = edges.select("callee", "caller").distinct().orderBy("callee", "caller").collect()
    many = {r.key for r in ambiguous.select("key").collect()}
    number: dict[str, int] = {root: 0}
    for r in rows:
        for k in (r.callee, r.caller):
            number.setdefault(k, len(number))
    quoted = lambda k: k.replace('"', "#quot;")
    out = ["graph BT"]
    out += [f'  n{i}["{quoted(k)}{" …" if k in many and k != root else ""}"]{":::root" if k == root else ""}' for k, i in number.items()]
    out += [f"  n{number[r.caller]} --> n{number[r.callee]}" for r in rows]
    return "\n".join([*out, "  classDef root stroke-width:3px"])
