"""Queries over what stands around the rules: languages, history, impact, reports, trends; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.common import saved
from tessera.operators import code_rules as code
from tessera.operators import graph, impact, insights, reports
from tessera.parse import nodes as trees
from tessera.plans import code_cases
from tessera.plans import tables as t
from tessera.sources import files as src
from tessera.sources import history
from tessera.sources import projects as pr

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# --- sources


@query("src_language_counts", "SELECT CASE lang WHEN 'en' THEN 'csharp' WHEN 'fr' THEN 'sql' WHEN 'de' THEN 'settings' END AS language, count(*) AS n FROM documents GROUP BY ALL")
def language_counts(spark, d):
    ending = F.when(F.col("lang") == "en", "A.cs").when(F.col("lang") == "fr", "a.SQL").when(F.col("lang") == "de", "AppSettings.Dev.json").otherwise("a.txt")
    path = F.concat_ws("/", "source", ending)
    return t.document_files(spark, d).select(src.language(path).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


@query("src_single_file", f"WITH {t.PAGES} SELECT file_id, path FROM p WHERE lower(path) = (SELECT lower(min(path)) FROM p)")
def single_file(spark, d):
    p = t.page_files(spark, d)
    least = p.agg(F.min("path")).first()[0] or ""
    return src.single_file(p, least.upper()).select("file_id", "path")


#: A settings file for each customer: of an even one in its nation's folder, of the others one folder below; every third is broken.
SETTINGS_SQL = """s AS (SELECT c_custkey AS file_id, CAST(c_nationkey AS VARCHAR) AS project, c_custkey % 2 = 0 AS own, c_custkey % 3 = 0 AS broken FROM customer)"""


def settings(spark, d):
    c = t.table(spark, d, "customer")
    folder = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit("/sub")))
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit('{"a": ')).otherwise(F.concat(F.lit('{"a": {"b": ['), F.col("c_custkey").cast("string"), F.lit(', {"c": "x"}]}, "d": null}')))
    return c.select(F.col("c_custkey").alias("file_id"), F.concat(folder, F.lit("/appsettings."), F.col("c_custkey").cast("string"), F.lit(".json")).alias("path"), text.alias("text"))


def folders(spark, d):
    return t.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("project"))


@query("src_settings", f"WITH {SETTINGS_SQL} SELECT project, file_id FROM s WHERE own")
def settings_of(spark, d):
    return src.settings_files(settings(spark, d), folders(spark, d)).select("project", "file_id")


@query("src_settings_leaves", f"WITH {SETTINGS_SQL} SELECT file_id, 'a:b:0' AS path, CAST(file_id AS VARCHAR) AS value FROM s WHERE NOT broken UNION ALL SELECT file_id, 'a:b:1:c', 'x' FROM s WHERE NOT broken")
def settings_leaves(spark, d):
    return src.json_leaves(settings(spark, d).select("file_id", "text")).where("value is not null")


@query("rule_ar0031", f"WITH {SETTINGS_SQL} SELECT file_id FROM s WHERE own AND broken")
def broken_settings(spark, d):
    return src.malformed(src.settings_files(settings(spark, d), folders(spark, d))).select("file_id")


#: A project for each customer. Tens of them refer to one another in a ring if their decade is even; every seventh can't be read.
PROJECTS_SQL = """c AS (SELECT c_custkey AS k, c_custkey // 10 AS decade, c_custkey % 7 = 0 AND (c_custkey // 10) % 2 = 1 AS broken FROM customer),
  whole AS (SELECT decade FROM c WHERE decade % 2 = 0 GROUP BY decade HAVING count(*) = 10)"""


def projects(spark, d):
    k = F.col("c_custkey")
    decade = F.floor(k / 10)
    last = k % 10 == 9
    target = F.when(~last, k + 1).when(decade % 2 == 0, k - 9)
    include = F.when(target.isNotNull(), F.concat(F.lit('<ProjectReference Include="..\\'), target.cast("string"), F.lit("\\p.csproj\" />")))
    text = F.when((k % 7 == 0) & (decade % 2 == 1), F.lit("<Project><Item>")).otherwise(F.concat(F.lit("<Project><ItemGroup>"), F.coalesce(include, F.lit("")), F.lit("</ItemGroup></Project>")))
    return t.table(spark, d, "customer").select(k.alias("file_id"), F.concat(k.cast("string"), F.lit("/p.csproj")).alias("path"), text.alias("text"))


@query("rule_ar0040", f"WITH {PROJECTS_SQL} SELECT k || '/p.csproj' AS node, CAST(10 AS BIGINT) AS size FROM c JOIN whole USING (decade)")
def project_rings(spark, d):
    p = projects(spark, d)
    known = pr.references(pr.parsed(p)).join(p.select(F.col("path").alias("target")), "target", "left_semi")
    return graph.cycles(known.select(F.col("target").alias("callee"), F.col("project").alias("caller"))).select("node", "size")


@query("rule_ar0041", f"WITH {PROJECTS_SQL} SELECT k || '/p.csproj' AS path FROM c WHERE broken")
def broken_projects(spark, d):
    return pr.parsed(projects(spark, d)).where("error is not null").select("path")


@query("src_project_references", f"WITH {PROJECTS_SQL} SELECT k || '/p.csproj' AS project, (CASE WHEN k % 10 <> 9 THEN k + 1 ELSE k - 9 END) || '/p.csproj' AS target FROM c WHERE NOT broken AND (k % 10 <> 9 OR decade % 2 = 0)")
def project_references(spark, d):
    return pr.references(pr.parsed(projects(spark, d)))


# --- parsed code


@query("parse_members", "SELECT c_custkey AS file_id, 'M' || i || '/0' AS key, CAST(i + 1 AS BIGINT) AS line, i % 3 = 1 AS is_test FROM customer, range(0, 5) t(i) WHERE i < 2 + c_nationkey % 4")
def members(spark, d):
    return code.members(code_cases.tree(spark, d, CALLS)).select("file_id", "key", *long("line"), "is_test")


#: Members that call the one before them, some of them tests.
CALLS = code_cases.Case("calls", ("void M{i}() { M0(); this.Next(1, 2).Tail; }", "[Fact] public void M{i}() { M0(); M0(); }", "int M{i}() { return new Thing(1).Size(); }"), ("void M{i}() { M0(); this.Next(1, 2).Tail; }", "[Fact] public void M{i}() { M0(); M0(); }", "int M{i}() { return new Thing(1).Size(); }"))


@query("parse_call_edges", """SELECT c_custkey AS file_id, unnest(CASE i % 3 WHEN 0 THEN ['M0/0', 'Next/2', 'Tail/0'] WHEN 1 THEN ['M0/0'] ELSE ['Thing/1', 'Size/0'] END) AS callee, 'M' || i || '/0' AS caller
  FROM customer, range(0, 5) t(i) WHERE i < 2 + c_nationkey % 4""")
def call_edges(spark, d):
    return code.call_edges(code_cases.tree(spark, d, CALLS)).select("file_id", "callee", "caller")


@query("parse_complexity", "SELECT c_custkey AS file_id, CAST(i + 1 AS BIGINT) AS line, CAST(CASE WHEN (c_custkey + i) % 2 = 0 THEN 21 WHEN i % 2 = 0 THEN 15 END AS BIGINT) AS score FROM customer, range(0, 5) t(i) WHERE i < 2 + c_nationkey % 4 AND ((c_custkey + i) % 2 = 0 OR i % 2 = 0)")
def complexity(spark, d):
    tree = code_cases.tree(spark, d, next(c for c in code_cases.PLAIN_CASES if c.rule == "AR0060"), code.complexity)
    at = tree.where("kind = 'Method'").select(F.col("file_id").alias("_f"), F.col("node").alias("_n"), "start_line").hint("merge")
    score = code.complexity(tree)
    return score.join(at, (F.col("file_id") == F.col("_f")) & (F.col("method") == F.col("_n"))).select("file_id", F.col("start_line").cast("long").alias("line"), F.col("score").cast("long").alias("score"))


#: A deletion or an update on every line, as the SQL counts them. The cases of SQ0020 have lines that are neither.
CHANGES = code_cases.Case("changes", ("DELETE FROM t{i};", "UPDATE t{i} SET a = 1;", "UPDATE #t{i} SET a = 1;"), ("DELETE FROM #t{i};", "DELETE FROM t{i} WHERE a = 1;", "UPDATE t{i} SET a = 1 WHERE b = 2;"), code_cases.TEXT)


@query("parse_sql_items", "SELECT CASE WHEN (c_custkey + i) % 2 = 0 THEN CASE WHEN i % 3 = 0 THEN 'Delete' ELSE 'Update' END WHEN i % 3 = 2 THEN 'Update' ELSE 'Delete' END AS kind, count(*) AS n FROM customer, range(0, 5) t(i) WHERE i < 2 + c_nationkey % 4 GROUP BY ALL")
def sql_items(spark, d):
    items = trees.sql_items(code_cases.files(spark, d, CHANGES))
    return items.where("kind in ('Delete', 'Update')").groupBy("kind").agg(F.count("*").alias("n"))


# --- history


@query("history_blame", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN lpad(CAST(o_orderkey + 1 AS VARCHAR), 40, '0') END AS hash, CASE WHEN o_orderstatus <> 'P' THEN 'C ' || o_custkey END AS author, CASE WHEN o_orderstatus <> 'P' THEN CAST(epoch(o_orderdate) AS BIGINT) END AS written, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS summary FROM orders")
def blame(spark, d):
    """What blame would print of a line for each order; pending ones aren't committed."""
    o = t.table(spark, d, "orders")
    h = F.when(F.col("o_orderstatus") == "P", F.lit("0" * 40)).otherwise(F.lpad((F.col("o_orderkey") + 1).cast("string"), 40, "0"))
    text = F.concat(h, F.lit(" 1 1 1\nauthor C "), F.col("o_custkey").cast("string"), F.lit("\nauthor-mail <c@x>\nauthor-time "), F.unix_timestamp("o_orderdate").cast("string"), F.lit("\nsummary "), "o_orderpriority", F.lit("\nfilename a.cs\n\tauthor code"))
    return history.blame(o.select("o_orderkey", text.alias("text"))).select("o_orderkey", "hash", "author", F.unix_timestamp("at").alias("written"), "summary")


@query("history_changed_lines", "WITH h AS (SELECT l_orderkey AS file, l_linenumber * 100 AS first, CAST(l_quantity AS BIGINT) % 4 AS n FROM lineitem) SELECT file, count(DISTINCT line) AS n, min(line) AS first, max(line) AS last FROM (SELECT file, CAST(first - 1 + unnest(range(0, n)) AS BIGINT) AS line FROM h) GROUP BY file")
def changed(spark, d):
    """A hunk for each line item: of one line the count is left out, of none it is a deletion."""
    n = F.col("l_quantity").cast("long") % 4
    head = F.concat(F.lit("@@ -1,2 +"), (F.col("l_linenumber") * 100).cast("string"), F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit(","), n.cast("string"))), F.lit(" @@ void F()\n+x\n"))
    diffs = t.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.array_join(F.collect_list(head), "").alias("text"))
    return history.changed_lines(diffs).groupBy("file").agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max("line").alias("last"))


@query("history_issue_keys", "SELECT p_partkey, nullif(regexp_extract(p_brand, '[A-Z][a-z]+#[0-9]+'), '') AS key, 'https://issues/' || nullif(regexp_extract(p_brand, '[A-Z][a-z]+#[0-9]+'), '') AS url FROM part")
def issue_keys(spark, d):
    p = t.table(spark, d, "part").withColumn("key", history.issue_key(F.col("p_brand"), "[A-Z][a-z]+#[0-9]+"))
    return p.select("p_partkey", "key", history.issue_url(F.col("key"), "https://issues/{key}").alias("url"))


# --- impact: customers are members of their nation's key, orders their calls

IMPACT_SQL = """m AS (SELECT c_custkey AS node, c_nationkey AS file_id, c_custkey % 200 AS key, 'f' || c_nationkey AS path, n_regionkey AS project, c_mktsegment = 'BUILDING' AS is_test FROM customer JOIN nation ON c_nationkey = n_nationkey),
  e AS (SELECT o_orderkey % 200 AS callee, key AS caller, node, path, project, is_test FROM orders JOIN m ON o_custkey = node),
  d AS (SELECT callee AS key, count(DISTINCT node) AS n_callers, count(DISTINCT project) AS n_projects FROM e GROUP BY callee),
  k AS (SELECT DISTINCT callee, caller FROM e), r(root, key, depth) AS (SELECT DISTINCT key, key, 0 FROM m WHERE file_id = 3 UNION SELECT root, caller, depth + 1 FROM r JOIN k ON r.key = callee WHERE depth < 2),
  f AS (SELECT root, key, min(depth) AS depth FROM r GROUP BY ALL),
  tests AS (SELECT root AS key, count(DISTINCT e.node) AS n_tests FROM f JOIN e ON f.key = e.callee WHERE depth < 2 AND is_test GROUP BY root),
  ends AS (SELECT DISTINCT root AS key FROM f JOIN k ON f.key = callee WHERE depth = 2)"""


def calls(spark, d):
    c = t.table(spark, d, "customer").join(t.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = (F.col("c_custkey") % 200).cast("string")
    m = c.select(F.col("c_nationkey").alias("file_id"), F.col("c_custkey").alias("node"), key.alias("key"), F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("path"), F.col("n_regionkey").cast("string").alias("project"), F.col("c_custkey").alias("line"), F.lit(0).alias("col"), (F.col("c_mktsegment") == "BUILDING").alias("is_test"))
    own = m.select(F.col("node").alias("_n"), F.col("key").alias("caller"), "file_id")
    e = t.table(spark, d, "orders").join(own, F.col("o_custkey") == F.col("_n")).select((F.col("o_orderkey") % 200).cast("string").alias("callee"), "caller", "file_id", F.col("_n").alias("node")).distinct()
    return saved(m), saved(e)


@query("impact_members", f"WITH RECURSIVE {IMPACT_SQL} SELECT m.node, CAST(m.key AS VARCHAR) AS key, coalesce(n_callers, 0) AS n_callers, coalesce(n_projects, 0) AS n_projects, coalesce(n_tests, 0) AS n_tests, ends.key IS NOT NULL AS bounded FROM m LEFT JOIN d USING (key) LEFT JOIN tests USING (key) LEFT JOIN ends ON ends.key = m.key WHERE file_id = 3")
def impact_members(spark, d):
    """The members of one file, as a change of it asks."""
    m, e = calls(spark, d)
    return impact.impact(m.where("file_id = 3"), m, e, 2).drop("file_id")


@query("impact_labels", f"WITH RECURSIVE {IMPACT_SQL}, x AS (SELECT m.node, coalesce(n_callers, 0) AS a, coalesce(n_projects, 0) AS b, coalesce(n_tests, 0) AS c FROM m LEFT JOIN d USING (key) LEFT JOIN tests USING (key) WHERE file_id = 3) SELECT node, '~' || a || CASE a WHEN 1 THEN ' caller' ELSE ' callers' END || ' in ' || b || CASE b WHEN 1 THEN ' project' ELSE ' projects' END || ' · ≥' || c || CASE c WHEN 1 THEN ' covering test' ELSE ' covering tests' END AS label FROM x")
def impact_labels(spark, d):
    m, e = calls(spark, d)
    return impact.impact(m.where("file_id = 3"), m, e, 2).select("node", impact.label().alias("label"))


@query("impact_callers", f"WITH RECURSIVE {IMPACT_SQL}, x AS (SELECT DISTINCT callee, path, node FROM e) SELECT CAST(callee AS VARCHAR) AS callee, path, node AS line, row_number() OVER (PARTITION BY callee ORDER BY path, node) AS place FROM x QUALIFY place <= 5")
def impact_callers(spark, d):
    m, e = calls(spark, d)
    return impact.first_callers(impact.callers(m, e), 5).select("callee", "path", "line", *long("place"))


# --- trends and debt

REVISIONS_SQL = "v AS (SELECT event_id AS revision, ts AS moment, CASE event_id % 5 WHEN 1 THEN NULL WHEN 2 THEN [] ELSE [event_type, 'other', event_type] END AS entries FROM events), z AS (SELECT * FROM v WHERE entries IS NOT NULL ORDER BY moment DESC, revision DESC LIMIT 20)"


@query("trend_selected", f"WITH {REVISIONS_SQL} SELECT revision, CAST(len(entries) AS BIGINT) AS total, CAST(len(entries) - lag(len(entries), 1, len(entries)) OVER (ORDER BY moment, revision) AS BIGINT) AS delta, coalesce((SELECT string_agg(x || '=' || n, ',' ORDER BY x) FROM (SELECT x, count(*) AS n FROM (SELECT unnest(z.entries) AS x) GROUP BY x)), '') AS by_rule FROM z")
def trend_selected(spark, d):
    """Events as revisions of a baseline: of every fifth it can't be read, of another fifth it is empty."""
    one = F.concat(F.lit('[{"ruleId":"'), "rule_id", F.lit('"},{"ruleId":"other"},{"ruleId":"'), "rule_id", F.lit('"}]'))
    text = F.when(F.col("commit") % 5 == 1, F.lit('[{"ruleId"')).when(F.col("commit") % 5 == 2, F.lit("[]")).otherwise(one)
    out = insights.summarised(insights.selected(t.commits(spark, d).select(F.col("commit").alias("revision"), F.col("ts").alias("at"), text.alias("text")), 20))
    said = F.array_join(F.transform(F.map_entries("by_rule"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return out.select("revision", *long("total", "delta"), said.alias("by_rule"))


# --- reports

FOUND = "found AS (SELECT c_custkey, 'n' || c_nationkey AS path, CAST(c_custkey % 90 AS BIGINT) AS line, 'R' || c_custkey % 7 AS rule_id, c_name AS message, CASE c_custkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'information' ELSE 'hint' END AS severity, c_mktsegment AS category, md5(c_name) AS fingerprint FROM customer)"


def found(spark, d):
    """A finding for each customer."""
    k = F.col("c_custkey")
    severity = F.when(k % 4 == 0, "error").when(k % 4 == 1, "warning").when(k % 4 == 2, "information").otherwise("hint")
    return t.table(spark, d, "customer").select(k.alias("c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), (k % 90).alias("line"), F.lit(0).alias("col"), F.concat(F.lit("R"), (k % 7).cast("string")).alias("rule_id"), F.col("c_name").alias("message"), severity.alias("severity"), F.col("c_mktsegment").alias("category"), F.md5("c_name").alias("fingerprint"))


@query("report_console_files", f"WITH {FOUND} SELECT path, count(*) AS n, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity IN ('information', 'hint')) AS lower FROM found GROUP BY path")
def console_files(spark, d):
    return reports.by_file(found(spark, d)).drop("rows")


@query("report_json_rows", f"""WITH {FOUND} SELECT CAST(json_object('ruleId', rule_id, 'message', message, 'file', path, 'startLine', line, 'severity', severity, 'category', category, 'fingerprint', fingerprint) AS VARCHAR) AS value FROM found""")
def json_rows(spark, d):
    return reports.json_rows(found(spark, d))


@query("report_sarif_results", f"""WITH {FOUND} SELECT CAST(json_object('ruleId', rule_id, 'level', CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END, 'message', json_object('text', message),
  'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', path), 'region', json_object('startLine', line + 1, 'startColumn', 1)))), 'partialFingerprints', json_object('primaryLocationLineHash', fingerprint)) AS VARCHAR) AS value FROM found""")
def sarif_results(spark, d):
    return reports.sarif_results(found(spark, d))


@query("report_baseline_rows", f"WITH {FOUND} SELECT CAST(json_object('fingerprint', fingerprint, 'ruleId', rule_id, 'file', path, 'message', message) AS VARCHAR) AS value FROM found")
def baseline_rows(spark, d):
    return reports.baseline_rows(found(spark, d))


CATALOG_SQL = "cat AS (SELECT 'R' || n_nationkey AS rule_id, n_name AS pattern, CASE WHEN n_regionkey = 0 THEN 'off' ELSE 'hint' END AS severity, 'g' || n_regionkey AS category FROM nation)"


def catalog(spark, d):
    n = t.table(spark, d, "nation")
    return n.select(F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("rule_id"), F.col("n_name").alias("pattern"), F.when(F.col("n_regionkey") == 0, "off").otherwise("hint").alias("severity"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("category"))


@query("report_patterns", f"WITH {FOUND}, {CATALOG_SQL} SELECT c_custkey, pattern FROM found LEFT JOIN cat USING (rule_id)")
def patterns(spark, d):
    return reports.with_patterns(found(spark, d), catalog(spark, d).select(F.lower("rule_id").alias("rule_id"), "pattern")).select("c_custkey", "pattern")


@query("report_rules_tree", f"WITH {FOUND}, {CATALOG_SQL}, n AS (SELECT rule_id, count(*) AS n FROM found GROUP BY ALL) SELECT cat.category, count(*) AS total, count(*) FILTER (severity <> 'off') AS enabled, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_findings FROM cat LEFT JOIN n USING (rule_id) GROUP BY cat.category")
def rules_tree(spark, d):
    return reports.rules_tree(catalog(spark, d), found(spark, d)).drop("rules")


@query("report_changed_lines", f"WITH {FOUND} SELECT c_custkey FROM found WHERE path LIKE '%1%' AND line % 3 = 0")
def on_changed_lines(spark, d):
    rows = found(spark, d)
    changed = rows.where("path like '%1%' and line % 3 = 0").select(F.col("path").alias("file"), "line").distinct()
    return history.on_changed_lines(rows, changed).select("c_custkey")


@query("report_quick_fixes", r"""WITH l AS (SELECT c_custkey, i, CASE i WHEN 0 THEN 'return x.Y(1).Count() > 0;' WHEN 1 THEN 'if (a && x.Count() == 0) F();' WHEN 2 THEN 'x.ToList().Any()' WHEN 3 THEN 'x.Count() > 1' END AS text FROM customer, range(0, 4) t(i))
  SELECT c_custkey, CAST(i AS BIGINT) AS i, CASE i WHEN 0 THEN 'return x.Y(1).Any();' WHEN 1 THEN 'if (a && !x.Any()) F();' WHEN 2 THEN 'x.Any()' END AS fix FROM l""")
def quick_fixes(spark, d):
    texts = ["return x.Y(1).Count() > 0;", "if (a && x.Count() == 0) F();", "x.ToList().Any()", "x.Count() > 1"]
    rows = t.table(spark, d, "customer").select("c_custkey", F.posexplode(F.array(*(F.lit(x) for x in texts))).alias("i", "text"))
    rule = F.when(F.col("i") == 2, "AR0022").otherwise("AR0020")
    return rows.select("c_custkey", *long("i"), reports.suggested_fix(rule, F.col("text")).alias("fix"))
