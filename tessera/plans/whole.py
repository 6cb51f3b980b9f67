"""Queries that run whole mechanisms over the driver's tables: the store, histories, components, impact of all, a full check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import engine
from tessera.common import saved, shared_path
from tessera.config import Config
from tessera.operators import graph, impact
from tessera.plans import code_cases
from tessera.plans import surface
from tessera.plans import tables as t
from tessera.sources import commits
from tessera.sources import files as src
from tessera.streaming.store import Store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


# --- owners: what a path starts with, not ending at a folder


@query(
    "src_project_prefix",
    f"WITH {t.FILES}, p AS (SELECT DISTINCT upper(substr(path, 1, CAST(3 + file_id % 9 AS INT))) AS project FROM files WHERE file_id % 20 = 0) SELECT file_id, arg_max(project, length(project)) AS project FROM files JOIN p ON starts_with(lower(path), lower(project)) GROUP BY file_id",
)
def project_prefix(spark, d):
    files = t.document_files(spark, d).select("file_id", "path")
    start = F.substring("path", F.lit(1), (3 + F.col("file_id") % 9).cast("int"))
    return src.prefix_owner(files, files.where("file_id % 20 = 0").select(F.upper(start).alias("project")))


# --- the store: all documents, then a batch of edits and deletions that comes twice


@query(
    "src_store",
    f"WITH {t.FILES}, now AS (SELECT file_id, path, CASE WHEN file_id % 5 = 0 THEN text || chr(10) || 'edited' ELSE text END AS text FROM files WHERE file_id % 7 <> 0) SELECT file_id, path, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM now",
)
def store(spark, d):
    files = t.document_files(spark, d).select("file_id", "path", F.col("lang").alias("language"), "text")
    held = Store(spark, shared_path(spark), {"lines": lambda files, made: src.lines(files)}, buckets=16)
    held.sync(files, 0)
    text = F.when(F.col("file_id") % 7 != 0, F.concat("text", F.lit("\nedited")))
    change = files.where("file_id % 7 = 0 or file_id % 5 = 0").withColumn("text", text)
    held.apply(change, 1)
    held.apply(change, 1)
    n = held.table("lines").groupBy("file_id").agg(F.count("*").alias("n_lines"))
    return held.table("files").select("file_id", "path").join(n, "file_id")


# --- histories: a user's events are the commits of a file, and each tenth of all events renames it

HISTORY_SQL = """h AS (SELECT event_id, user_id, count(*) FILTER (event_id % 10 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  n AS (SELECT DISTINCT user_id, k AS j FROM h UNION SELECT user_id, 0 FROM h WHERE event_id % 10 = 0 AND k = 1)"""


def history(spark, d) -> DataFrame:
    """Changes as ``commits.changes`` gives them."""
    e = t.table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 10 == 0).alias("renames"))
    k = F.count_if("renames").over(Window.partitionBy("user_id").orderBy("event_id"))
    name = lambda n: F.concat_ws(".", F.col("user_id").cast("string"), n.cast("string"))
    e = e.withColumn("k", k)
    status = F.when(F.col("renames"), "R").otherwise("M")
    old = F.when(F.col("renames"), name(F.col("k") - 1)).otherwise(name(F.col("k")))
    blob = F.col("event_id").cast("string")
    return e.select(blob.alias("hash"), "ts", (-F.col("event_id")).alias("back"), status.alias("status"), old.alias("old_file"), name(F.col("k")).alias("file"), blob.alias("old_blob"), blob.alias("blob"))


@query(
    "src_history",
    f"WITH {HISTORY_SQL} SELECT user_id || '.' || j AS file, CAST(event_id AS VARCHAR) AS hash, user_id || '.' || least(k, j) AS name FROM n JOIN h USING (user_id) WHERE k <= j OR (k = j + 1 AND event_id % 10 = 0)",
)
def histories(spark, d):
    return commits.followed(history(spark, d)).select("file", "hash", "name")


# --- components: what follows what in a user's events

STEPS_SQL = """s AS (SELECT DISTINCT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
  r(user_id, a, b) AS (SELECT user_id, a, b FROM s WHERE b IS NOT NULL AND a <> b UNION SELECT r.user_id, r.a, s.b FROM r JOIN s ON r.user_id = s.user_id AND r.b = s.a WHERE s.b IS NOT NULL),
  g AS (SELECT x.user_id, x.a AS node, x.b AS other FROM r x JOIN r y ON x.user_id = y.user_id AND x.a = y.b AND x.b = y.a)"""


@query("graph_components", f"WITH RECURSIVE {STEPS_SQL} SELECT user_id || ':' || node AS node, user_id || ':' || min(other) AS component, count(DISTINCT other) AS size FROM g GROUP BY user_id, node HAVING count(DISTINCT other) > 1")
def components(spark, d):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    name = lambda c: F.concat_ws(":", F.col("user_id").cast("string"), F.col(c))
    steps = t.table(spark, d, "events").withColumn("next", after).where("next is not null")
    return graph.cycles(steps.select(name("event_type").alias("caller"), name("next").alias("callee")))


# --- impact of a change of every member

ALL_SQL = surface.IMPACT_SQL.replace(" FROM m WHERE file_id = 3 UNION", " FROM m UNION")


@query(
    "impact_all",
    f"WITH RECURSIVE {ALL_SQL} SELECT m.node, CAST(m.key AS VARCHAR) AS key, coalesce(n_callers, 0) AS n_callers, coalesce(n_projects, 0) AS n_projects, coalesce(n_tests, 0) AS n_tests, ends.key IS NOT NULL AS bounded FROM m LEFT JOIN d USING (key) LEFT JOIN tests USING (key) LEFT JOIN ends ON ends.key = m.key",
)
def impact_all(spark, d):
    m, e = surface.calls(spark, d)
    return impact.impact(m, m, e, 2).drop("file_id")


# --- a full check over code made from customers: severities, suppression, baseline

CHECKED = {c.rule: c for c in (*code_cases.PLAIN_CASES, *code_cases.SQL_CASES) if c.rule in ("AR0013", "AR0070", "SQ0001")}
CHECK_SQL = " UNION ALL ".join(
    f"SELECT path, rule_id, line, severity, CASE WHEN file_id % 3 = 0 THEN 'baselined' ELSE 'new' END AS state FROM (SELECT '{rule}/' || file_id || '{ending}' AS path, file_id, rule_id, line, '{severity}' AS severity FROM ({CHECKED[rule].sql()})) WHERE file_id % 5 <> 0"
    for rule, ending, severity in (("AR0013", ".cs", "error"), ("AR0070", ".cs", "hint"))
)


def checked_files(spark, d) -> DataFrame:
    """A file of each case for each customer; every fifth is told to be left alone. SQ0001 is switched off."""
    out = None
    for rule, case in CHECKED.items():
        ending, language, comment = (".sql", "sql", "--") if rule.startswith("SQ") else (".cs", "csharp", "//")
        mark = F.when(F.col("file_id") % 5 == 0, F.lit(f"\n{comment} lens-ignore-file [{rule}]")).otherwise(F.lit(""))
        path = F.concat(F.lit(f"{rule}/"), F.col("file_id").cast("string"), F.lit(ending))
        one = code_cases.files(spark, d, case).select("file_id", path.alias("path"), F.lit(language).alias("language"), F.concat("text", mark).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("customer", F.col("file_id")).withColumn("file_id", F.xxhash64("path"))


@query("engine_check", CHECK_SQL)
def check(spark, d):
    files = saved(checked_files(spark, d))
    config = Config(rules={"AR0013": "error", "AR0070": "hint", "SQ0001": "off"})
    asked = F.col("path").startswith(F.concat(F.col("rule_id"), F.lit("/")))
    before = engine.check(files.where("customer % 3 = 0").drop("customer"), config).findings
    result = engine.check(files.drop("customer"), config, baseline=saved(before.select("fingerprint")))
    rows = [f.where(asked).select("path", "rule_id", F.col("line").cast("long").alias("line"), "severity", F.lit(state).alias("state")) for f, state in ((result.findings, "new"), (result.baselined, "baselined"))]
    return rows[0].unionByName(rows[1])
