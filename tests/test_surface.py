import io
import json
import subprocess

import pytest

from tessera import cli
from tessera.operators import graph, impact, reports
from tessera.parse import nodes
from tessera.parse.tsql_format import formatted, has_inline_comments
from tessera.session import Session
from tessera.sources import history, projects

QUERIES = [
    "select a,b from t where x=1 and y in (select z from q) order by a;delete from t where a= -1",
    "if exists(select 1 from t) begin update t set a=case when b=1 then 2 else 3 end where c='x' end else begin print 'n' end",
    "-- head\n/* more */ select 1\ngo\n-- mid\nselect 'select from' as [from]; -- tail",
    "create procedure p as begin begin select 1; -- inner\n end /* done */ end",
    "insert into t (a,b) select a,b from u left join v on u.a=v.a group by a having count(*)>1",
    "",
]


@pytest.mark.parametrize("text", QUERIES)
def test_layout(text):
    once = formatted(text)
    assert formatted(once) == once
    for comment in ("-- head", "/* more */", "-- mid", "-- tail", "-- inner", "/* done */"):
        assert (comment in once) == (comment in text)
    assert once.count("GO") == text.count("go\n")


def test_layout_leaves_what_it_cannot_read():
    assert formatted("select from from\n\n where") == "select from from\n\n where"
    assert formatted("select a, b from t") == "SELECT a,\n       b\nFROM   t\n"
    assert has_inline_comments("select a, -- why\n b from t") and not has_inline_comments("-- head\nselect a from t;\n-- tail\nselect 1")


def test_layouts(spark):
    got = nodes.sql_layouts(spark.createDataFrame([(1, "select 1"), (2, "SELECT 1\n"), (3, "select from")], "file_id long, text string")).collect()
    assert sorted((r.file_id, r.changed) for r in got) == [(1, True), (2, False), (3, False)]


def test_history(spark):
    text = "f" * 40 + " 3 3 1\nauthor Some One\nauthor-time 86400\nsummary Add: it\n\tcode"
    got = history.blame(spark.createDataFrame([(1, text), (2, "0" * 40 + " 1 1 1\nauthor Not Committed Yet"), (3, "junk")], "id int, text string")).orderBy("id").collect()
    assert (got[0].hash, got[0].author, got[0].summary) == ("f" * 40, "Some One", "Add: it") and got[1].hash is got[1].author is got[2].hash is None
    diff = "@@ -1,2 +3 @@\n+x\n@@ -4 +9,0 @@\n-y\n@@ -5,0 +20,2 @@"
    assert sorted(r.line for r in history.changed_lines(spark.createDataFrame([("a", diff)], "file string, text string")).collect()) == [2, 19, 20]
    keys = spark.createDataFrame([("fix ABC-12 and X-1",), ("none",)], "m string")
    assert [r[0] for r in keys.select(history.issue_key(keys.m, "[A-Z]+-[0-9]+")).collect()] == ["ABC-12", None]
    assert [r[0] for r in keys.select(history.issue_key(keys.m, "(")).collect()] == [None, None]


def test_impact_and_trace(spark):
    members = [(1, n, f"M{n}/0", f"{'ab'[n % 2]}/F.cs", "ab"[n % 2], 10 * n, 4, n == 3) for n in range(5)]
    m = spark.createDataFrame(members, "file_id long, node int, key string, path string, project string, line int, col int, is_test boolean")
    e = spark.createDataFrame([("M0/0", "M1/0", 1, 1), ("M0/0", "M2/0", 1, 2), ("M1/0", "M3/0", 1, 3), ("M3/0", "M4/0", 1, 4)], "callee string, caller string, file_id long, node int")
    got = {r.key: (r.n_callers, r.n_projects, r.n_tests, r.bounded) for r in impact.impact(m, m, e, 2).collect()}
    assert got == {"M0/0": (2, 2, 1, True), "M1/0": (1, 1, 1, False), "M2/0": (0, 0, 0, False), "M3/0": (1, 1, 0, False), "M4/0": (0, 0, 0, False)}
    assert [(r.line, r.place) for r in impact.first_callers(impact.callers(m, e), 1).where("callee = 'M0/0'").collect()] == [(20, 1)]
    text = reports.mermaid("M0/0", graph.trace("M0/0", e, m), graph.ambiguous(m.union(m.where("node = 3"))))
    assert text.startswith("graph BT") and '["M3/0 …"]' in text and text.count("-->") == 4


def test_explained(spark):
    rows = spark.createDataFrame([("R", "m", "x")], "rule_id string, message string, anchor string")
    assert reports.explained(rows).first().explanation is None
    assert reports.explained(rows, lambda rule, message, line: line).first().explanation == "x"


def test_shapes(spark):
    texts = ["class A { }", "void F() { }", "var x = 1; F(x);", "))) {{{"]
    got = projects.shapes(spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "snippet_id string, ordinal int, text string")).orderBy("snippet_id").collect()
    assert [r.shape for r in got] == ["Unit", "Member", "Statements", "Unparseable"]


@pytest.fixture()
def workspace(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "A.cs").write_text("class A {\n  void F(bool a) { if (a) { G(); } }\n  [Fact] void T() { F(true); }\n  void G() { try { F(false); } catch { } }\n}\n")
    (tmp_path / "q.sql").write_text("select * from t")
    (tmp_path / "lens-baseline.json").write_text('[{"fingerprint": "abc", "ruleId": "AR0013", "file": "A.cs", "message": "m"}]')
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "lens-baseline.json").write_text('[{"fingerprint": "abc", "ruleId": "AR0013", "file": "A.cs", "message": "m"}, {"fingerprint": "def", "ruleId": "SQ0001", "file": "q.sql", "message": "m"}]')
    run("commit", "-qam", "two")
    return tmp_path


def test_session(spark, workspace):
    s = Session(spark, str(workspace))
    assert {f["ruleId"] for f in s.analyze()["findings"]} == {"AR0013", "SQ0001"}
    s.set_severity("SQ0001", "off")
    s.reload_config()
    assert {f["ruleId"] for f in s.analyze("file", "q.sql")["findings"]} == set()
    assert s.format_file("q.sql") == "SELECT *\nFROM   t\n"
    f = next(r for r in s.method_impact("A.cs") if r["key"] == "F/1")
    assert (f["callers"], f["tests"]) == (2, 1) and len(f["callerList"]) == 2
    assert {(e["from"], e["to"]) for e in s.method_trace("A.cs", 1)["edges"]} >= {("T/0", "F/1"), ("G/0", "F/1")}
    asked = [{"id": 1, "method": "analyzeFile", "params": {"path": "q.sql", "text": "delete from t"}}, {"id": 2, "method": "analyseFile"}, {"id": 3, "method": "shutdown"}, {"id": 4, "method": "listRules"}]
    out = io.StringIO()
    s.serve(io.StringIO("\n".join(map(json.dumps, asked))), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["ruleId"] for x in said[0]["result"]["findings"]] == ["SQ0020"] and "did you mean 'analyzeFile'" in said[1]["error"] and len(said) == 3


def test_insight_commands(spark, workspace, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["format", str(workspace), "--check"]) == 3 and "q.sql" in capsys.readouterr().out
    assert cli.main(["format", str(workspace)]) == 0 and cli.main(["format", str(workspace), "--check"]) == 0
    capsys.readouterr()
    assert cli.main(["hotspots", str(workspace)]) == 0 and capsys.readouterr().out.endswith("A.cs\n")
    assert cli.main(["debt", str(workspace), "--fail-over", "5d"]) == 0 and capsys.readouterr().out.count("\n") == 2
    assert cli.main(["trend", str(workspace)]) == 0
    rows = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert [(r[2], r[3]) for r in rows] in ([("1", "+0"), ("2", "+1")], [("2", "+0"), ("1", "-1")])
    (workspace / "lens-baseline.json").write_text("{")
    assert cli.main(["check", str(workspace), "--format", "json"]) == 0
    out = capsys.readouterr()
    assert "baseline can't be read" in out.err and {"findings", "baselined", "skipped", "diagnostics", "counts"} == json.loads(out.out).keys()
