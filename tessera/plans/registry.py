"""All queries of the library by name, with the SQL that gives the same rows.

``@query(name, sql)`` registers a function of (spark, sf_dir). Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import findings as fi
from tessera.operators import graph, insights, reports
from tessera.plans import code_cases, surface, whole
from tessera.plans import tables as t
from tessera.sources import files as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


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


EXCLUDED = ["**/fr/**", "*.net/**", "m.*/*/?2*"]


@query("src_glob_filter", f"WITH {t.PAGES} SELECT file_id, path FROM p WHERE NOT regexp_matches(path, '^(?:.*/)?fr/.*$') AND NOT regexp_matches(path, '^[^/]*\\.net/.*$') AND NOT regexp_matches(path, '^m\\.[^/]*/[^/]*/[^/]2[^/]*$')")
def glob_filter(spark, d):
    return t.page_files(spark, d).where(src.not_excluded(F.col("path"), EXCLUDED)).select("file_id", "path")


@query("src_lines", f"WITH {t.LINES} SELECT file_id, line, text FROM lines")
def lines(spark, d):
    return src.lines(t.document_files(spark, d)).select("file_id", *long("line"), "text")


OWNERS = f"""WITH RECURSIVE {t.PAGES}, f AS (SELECT file_id, path, regexp_replace(path, '/?[^/]*$', '') AS folder FROM p),
  projects AS (SELECT DISTINCT host AS project FROM p UNION SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') FROM p),
  up(file_id, folder) AS (SELECT file_id, folder FROM f UNION SELECT file_id, regexp_replace(folder, '/?[^/]*$', '') FROM up WHERE folder <> '')"""


def projects(spark, d):
    p = t.page_files(spark, d)
    return p.select(F.col("host").alias("project")).union(p.select(src.directory(F.col("path")))).distinct()


@query("src_project_owners", OWNERS + " SELECT up.file_id, project FROM up JOIN projects ON up.folder = project")
def project_owners(spark, d):
    return src.owners(t.page_files(spark, d), projects(spark, d))


@query("src_project_nearest", OWNERS + " SELECT up.file_id, arg_max(project, length(project)) AS project FROM up JOIN projects ON up.folder = project GROUP BY up.file_id")
def project_nearest(spark, d):
    return src.nearest_owner(t.page_files(spark, d), projects(spark, d))


@query("src_json_leaves", "SELECT event_id AS file_id, 'k' AS path, props ->> '$.k' AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_leaves(spark, d):
    return src.json_leaves(t.commits(spark, d).select(F.col("commit").alias("file_id"), F.col("props").alias("text")))


# --- rules over text lines and relations


def duplicate_literals(lines: DataFrame, min_length: int = 10, least: int = 3) -> DataFrame:
    """Every line but the first among equal lines of a file that holds at least ``least`` of them."""
    from pyspark.sql import Window

    same = Window.partitionBy("file_id", "text")
    out = lines.where(F.length("text") >= min_length).withColumns({"n": F.count("*").over(same), "nth": F.row_number().over(same.orderBy("line"))})
    return out.where((F.col("n") >= least) & (F.col("nth") > 1))


DUPLICATES = t.LINES + """, dup AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY file_id, text) AS n, row_number() OVER (PARTITION BY file_id, text ORDER BY line) AS nth
  FROM lines WHERE length(text) >= 10) WHERE n >= 3 AND nth > 1)"""


CREDENTIAL = r"(?:password|passwd|secret|token|credential|api_?key)[A-Za-z0-9_]*\s*[:=]\s*[^\s]"


@query(
    "rule_longest_prefix",
    f"""WITH {t.FILES}, pre AS (SELECT DISTINCT source AS prefix FROM files UNION SELECT DISTINCT concat_ws('/', source, lang) FROM files),
    m AS (SELECT file_id, prefix, row_number() OVER (PARTITION BY file_id ORDER BY length(prefix) DESC, prefix) AS k FROM files JOIN pre ON starts_with(path, prefix))
    SELECT file_id, prefix FROM m WHERE k = 1""",
)
def longest_prefix(spark, d):
    f = t.document_files(spark, d)
    pre = f.select(F.col("source").alias("prefix")).union(f.select(F.concat_ws("/", "source", "lang"))).distinct().withColumn("ord", F.lit(0))
    return src.longest_prefix(f.select("file_id", "path"), "path", pre).select("file_id", "prefix")


# --- engine

SEVERITY_SETTINGS = [("rule", "click", "off"), ("rule", "view", " WARN "), ("category", "standard", "hint"), ("session", "view", "error"), ("rule", "purchase", "loud")]
SETTINGS_SQL = "s(scope, key, value) AS (VALUES ('rule', 'click', 'off'), ('rule', 'view', 'warning'), ('category', 'standard', 'hint'), ('session', 'view', 'error'))"
RULES_SQL = "r AS (SELECT DISTINCT event_type AS rule_id, CASE WHEN event_type < 'l' THEN 'standard' ELSE 'other' END AS category, 'information' AS default_severity FROM events)"
EFFECTIVE = f"""{SETTINGS_SQL}, {RULES_SQL}, eff AS (SELECT rule_id, category, coalesce((SELECT max(value) FROM s WHERE scope = 'session' AND key = rule_id), (SELECT max(value) FROM s WHERE scope = 'rule' AND key = rule_id),
    (SELECT max(value) FROM s WHERE scope = 'category' AND key = category), default_severity) AS severity FROM r)"""


def rules(spark, d):
    kinds = t.commits(spark, d).select("rule_id").distinct()
    table = kinds.select("rule_id", F.when(F.col("rule_id") < "l", "standard").otherwise("other").alias("category"), F.lit("information").alias("default_severity"))
    said = spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("scope", "key", "value"), s, strict=True))) for s in SEVERITY_SETTINGS))).alias("x")).select("x.*")
    return fi.effective_severities(table, said)


@query("engine_severity", f"WITH {EFFECTIVE} SELECT rule_id, category, severity FROM eff")
def engine_severity(spark, d):
    return rules(spark, d).select("rule_id", "category", "severity")


@query("engine_skipped", f"WITH {EFFECTIVE} SELECT rule_id, 'disabled by configuration' AS reason FROM eff WHERE severity = 'off'")
def engine_skipped(spark, d):
    return fi.skipped(rules(spark, d))


@query("engine_stamped", f"WITH {EFFECTIVE} SELECT user_id AS file, e.event_type AS rule_id, severity, category, count(*) AS n FROM events e JOIN eff ON event_type = rule_id WHERE severity <> 'off' GROUP BY ALL")
def engine_stamped(spark, d):
    return fi.stamped(t.commits(spark, d), rules(spark, d)).groupBy("file", "rule_id", "severity", "category").agg(F.count("*").alias("n"))


def text_findings(spark, d):
    """Duplicated lines and credential lines of the documents as raw findings."""
    f = t.document_files(spark, d)
    lines = src.lines(f)
    anchor = fi.trimmed(F.col("text")).alias("anchor")
    dup = duplicate_literals(lines).select("file_id", "line", F.lit("DUP").alias("rule_id"), F.lit("duplicated line").alias("message"), anchor)
    cred = lines.where(F.lower("text").rlike(CREDENTIAL)).select("file_id", "line", F.lit("CRED").alias("rule_id"), F.lit("credential in text").alias("message"), anchor)
    return dup.unionByName(cred).join(f.select("file_id", "path"), "file_id"), lines


FINDINGS = DUPLICATES + f""", found AS (SELECT file_id, path, line, 'DUP' AS rule_id, 'duplicated line' AS message, text FROM dup
    UNION ALL SELECT file_id, path, line, 'CRED', 'credential in text', text FROM lines WHERE regexp_matches(lower(text), '{CREDENTIAL}')),
  printed AS (SELECT *, row_number() OVER (PARTITION BY rule_id, path, message, anchor ORDER BY line, file_id) - 1 AS ordinal
    FROM (SELECT * EXCLUDE (text), trim(text, ' ' || chr(9) || chr(13)) AS anchor FROM found)),
  fp AS (SELECT *, substr(sha256(concat_ws(chr(10), rule_id, path, message, anchor, CAST(ordinal AS VARCHAR))), 1, 16) AS fingerprint FROM printed)"""


@query("engine_fingerprint", f"WITH {FINDINGS} SELECT path, rule_id, line, ordinal, fingerprint FROM fp")
def engine_fingerprint(spark, d):
    found, lines = text_findings(spark, d)
    return fi.fingerprinted(found).select("path", "rule_id", *long("line", "ordinal"), "fingerprint")


MARK = "password"


@query(
    "engine_suppression",
    f"""WITH {FINDINGS}, marked AS (SELECT file_id, line FROM lines WHERE regexp_matches(lower(text), '{MARK}') UNION SELECT file_id, line + 1 FROM lines WHERE regexp_matches(lower(text), '{MARK}'))
    SELECT path, rule_id, line FROM found WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.file_id = found.file_id AND m.line = found.line)""",
)
def engine_suppression(spark, d):
    """The documents hold no markers of ours; a word of theirs stands in for one."""
    found, lines = text_findings(spark, d)
    return fi.unsuppressed(found, fi.suppressions(lines, MARK)).select("path", "rule_id", *long("line"))


def baselined(spark, d):
    found, lines = text_findings(spark, d)
    printed = fi.fingerprinted(found)
    accepted = printed.where("rule_id = 'DUP' and line < 20").select(F.upper("fingerprint").alias("fingerprint"))
    return fi.split_by_baseline(printed, accepted)


BASE = FINDINGS + ", base AS (SELECT DISTINCT fingerprint FROM fp WHERE rule_id = 'DUP' AND line < 20)"


@query("engine_baselined", f"WITH {BASE} SELECT path, rule_id, line, fingerprint FROM fp WHERE fingerprint IN (SELECT fingerprint FROM base)")
def engine_baselined(spark, d):
    return baselined(spark, d)[1].select("path", "rule_id", *long("line"), "fingerprint")


@query("engine_reportable", f"WITH {BASE} SELECT path, rule_id, line, fingerprint FROM fp WHERE fingerprint NOT IN (SELECT fingerprint FROM base)")
def engine_reportable(spark, d):
    return baselined(spark, d)[0].select("path", "rule_id", *long("line"), "fingerprint")


@query("engine_at_least", f"WITH {EFFECTIVE} SELECT event_id, event_type AS rule_id, severity FROM events JOIN eff ON event_type = rule_id WHERE severity IN ('warning', 'error')")
def engine_at_least(spark, d):
    return fi.at_least(fi.stamped(t.commits(spark, d), rules(spark, d)), "warning").select(F.col("commit").alias("event_id"), "rule_id", "severity")


@query("engine_exit_codes", f"WITH {EFFECTIVE}, l(level, ord) AS (VALUES ('hint', 1), ('information', 2), ('warning', 3), ('error', 4), ('never', 5)), o AS (SELECT severity, list_position(['hint', 'information', 'warning', 'error'], severity) AS ord FROM events JOIN eff ON event_type = rule_id WHERE severity NOT IN ('off', 'error')) SELECT level, CAST(coalesce(bool_or(o.ord >= l.ord), false) AS BIGINT) AS code FROM l LEFT JOIN o ON true GROUP BY level")
def engine_exit_codes(spark, d):
    """What a run without errors ends with, for each level that may be asked to fail it."""
    found = fi.stamped(t.commits(spark, d), rules(spark, d)).where("severity <> 'error'")
    return spark.createDataFrame([(level, reports.exit_code(found, level)) for level in ("hint", "information", "warning", "error", "never")], "level string, code long")


@query("engine_anchored", f"WITH {FINDINGS} SELECT file_id, rule_id, line, anchor FROM printed")
def engine_anchored(spark, d):
    found, _ = text_findings(spark, d)
    files = t.document_files(spark, d).select("file_id", "text")
    return fi.anchored(found.drop("anchor"), files).select("file_id", "rule_id", *long("line"), "anchor")


@query("engine_gate", f"WITH {EFFECTIVE} SELECT count(*) FILTER (severity IN ('error')) AS errors, count(*) FILTER (severity IN ('error', 'warning')) AS warnings, count(*) FILTER (severity <> 'off') AS n FROM events JOIN eff ON event_type = rule_id")
def engine_gate(spark, d):
    stamped = fi.stamped(t.commits(spark, d), rules(spark, d))
    level = fi.rank(F.col("severity"))
    return stamped.agg(F.count_if(level >= 4).alias("errors"), F.count_if(level >= 3).alias("warnings"), F.count("*").alias("n"))


@query(
    "engine_suggest",
    """WITH u AS (SELECT DISTINCT p_brand AS word FROM part), k AS (SELECT DISTINCT p_brand || 'x' AS word FROM part WHERE p_size > 25),
    d AS (SELECT u.word, k.word AS suggestion, levenshtein(lower(u.word), lower(k.word)) AS distance FROM u, k)
    SELECT word, suggestion, CAST(distance AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, lower(suggestion), suggestion) AS i FROM d WHERE distance <= 2) WHERE i = 1""",
)
def engine_suggest(spark, d):
    p = t.table(spark, d, "part")
    return fi.suggestions(p.select(F.col("p_brand").alias("word")).distinct(), p.where("p_size > 25").select(F.concat("p_brand", F.lit("x")).alias("word")).distinct())


# --- insights


@query("graph_fan_in", f"WITH {t.EDGES} SELECT callee, count(*) AS n_calls, count(DISTINCT caller) AS n_callers FROM edges GROUP BY callee")
def graph_fan_in(spark, d):
    return graph.fan_in(t.calls(spark, d))


@query("graph_callers_topk", f"WITH {t.EDGES}, n AS (SELECT callee, caller, count(*) AS n FROM edges GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY callee ORDER BY n DESC, caller) AS place FROM n QUALIFY place <= 3")
def graph_callers_topk(spark, d):
    return graph.top_callers(t.calls(spark, d), 3).select("callee", "caller", "n", *long("place"))


@query("graph_ambiguous", "SELECT p_name AS key, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def graph_ambiguous(spark, d):
    return graph.ambiguous(t.table(spark, d, "part").select(F.col("p_name").alias("key")))


@query(
    "graph_reach",
    f"""WITH RECURSIVE {t.EDGES}, e AS (SELECT DISTINCT callee, caller FROM edges),
    r(root, key, depth) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0 FROM nation WHERE n_regionkey = 1 UNION SELECT root, caller, depth + 1 FROM r JOIN e ON key = callee WHERE depth < 6)
    SELECT root, key, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY root, key""",
)
def graph_reach(spark, d):
    roots = t.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("key"))
    return graph.reach(roots, t.calls(spark, d), 6).select("root", "key", *long("depth"))


@query(
    "graph_scc",
    f"""WITH RECURSIVE {t.EDGES}, e AS (SELECT DISTINCT caller AS a, callee AS b FROM edges WHERE callee <> caller),
    c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
    m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
    SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM m""",
)
def graph_scc(spark, d):
    return graph.cycles(t.calls(spark, d))


CHURNED = "ch AS (SELECT user_id AS file, count(*) AS churn FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events) GROUP BY user_id)"


def churned(spark, d):
    c = t.commits(spark, d)
    newest = c.agg(F.max("ts").alias("ts")).first()[0]
    return insights.churn(c, F.lit(newest) - F.expr("interval 10 days"))


@query("churn_since", f"WITH {CHURNED} SELECT file, churn FROM ch")
def churn_since(spark, d):
    return churned(spark, d)


@query("hotspots", f"WITH {CHURNED}, cx AS (SELECT user_id AS file, CAST(floor(sum(value)) AS BIGINT) AS complexity FROM events GROUP BY user_id) SELECT file, complexity, churn, complexity * churn AS score FROM cx JOIN ch USING (file) WHERE complexity > 0 AND churn > 0 ORDER BY score DESC, complexity DESC, file LIMIT 20")
def hotspots(spark, d):
    cx = t.commits(spark, d).groupBy("file").agg(F.floor(F.sum("value")).cast("long").alias("complexity"))
    return insights.hotspots(cx, churned(spark, d), 20)


DEBT = """b AS (SELECT o_orderkey AS fingerprint, o_orderpriority AS rule_id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS introduced FROM orders),
  c AS (SELECT l_orderkey AS fingerprint, count(*) AS churn FROM lineitem GROUP BY ALL), now AS (SELECT max(o_orderdate) AS ts FROM orders),
  debt AS (SELECT b.fingerprint, rule_id, CAST(coalesce(greatest(0, datesub('day', introduced, now.ts)), 0) AS BIGINT) AS age_days, CAST(coalesce(churn, 0) AS BIGINT) AS churn FROM b LEFT JOIN c USING (fingerprint), now)"""


def debt(spark, d):
    o = t.table(spark, d, "orders").withColumnRenamed("o_orderkey", "fingerprint")
    now = o.agg(F.max("o_orderdate")).first()[0]
    when = o.where("o_orderstatus <> 'O'").select("fingerprint", F.col("o_orderdate").alias("introduced"))
    churn = t.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("fingerprint")).agg(F.count("*").alias("churn"))
    return insights.debt(o.select("fingerprint", F.col("o_orderpriority").alias("rule_id")), when, churn, F.lit(now))


@query("debt_ranking", f"WITH {DEBT} SELECT fingerprint, rule_id, age_days, churn, age_days * churn AS score FROM debt")
def debt_ranking(spark, d):
    return debt(spark, d).select("fingerprint", "rule_id", "age_days", "churn", "score")


@query("debt_over_age", f"WITH {DEBT} SELECT rule_id, count(*) AS n, max(age_days) AS oldest FROM debt WHERE age_days > 365 GROUP BY rule_id")
def debt_over_age(spark, d):
    return insights.over_age(debt(spark, d), 365).groupBy("rule_id").agg(F.count("*").alias("n"), F.max("age_days").alias("oldest"))


@query("trend_totals", "WITH n AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS snapshot, count(*) AS total FROM orders GROUP BY ALL) SELECT snapshot, total, total - lag(total, 1, total) OVER (ORDER BY snapshot) AS delta FROM n")
def trend_totals(spark, d):
    return insights.trend(t.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("snapshot")))


@query("trend_by_rule", "SELECT strftime(o_orderdate, '%Y-%m') AS snapshot, o_orderpriority AS rule_id, count(*) AS n FROM orders GROUP BY ALL")
def trend_by_rule(spark, d):
    return t.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"), F.col("o_orderpriority").alias("rule_id")).agg(F.count("*").alias("n"))


@query("age_labels", f"WITH {DEBT} SELECT fingerprint, CASE WHEN age_days < 30 THEN age_days || 'd' WHEN age_days < 365 THEN age_days // 30 || 'mo' ELSE age_days // 365 || 'y' END AS age FROM debt")
def age_labels(spark, d):
    return debt(spark, d).select("fingerprint", insights.format_age(F.col("age_days")).alias("age"))


# --- rules over code made from rows

_queries, _oracles = code_cases.built()
QUERIES |= _queries | surface.QUERIES | whole.QUERIES
ORACLES |= _oracles | surface.ORACLES | whole.ORACLES
