import json

from tessera import cli, config, engine, rules
from tessera.operators import findings as fi
from tessera.operators import graph, reports
from tessera.sources import files as src

CODE = 'class A {\n  void F() { try { G(); } catch { } } // lens-ignore[AR0013]\n  void H(int x) { try { G(); } catch { } }\n  void I() { var s = "a"; Console.WriteLine(s); }\n}'
SQL = "SELECT * FROM t;\nDELETE FROM t;\n"


def files(spark):
    rows = [(1, "src/A.cs", "csharp", CODE), (2, "sql/a.sql", "sql", SQL), (3, "obj/B.cs", "csharp", CODE)]
    return spark.createDataFrame(rows, "file_id long, path string, language string, text string")


def test_check(spark):
    c = config.parse('{"rules": {"AR0073": "error", "performance": "off", "SQ0001": "none"}, // comment\n "options": {},}')
    assert not c.messages
    out = engine.check(files(spark), c)
    assert not out.failed
    got = sorted((r.path, r.line, r.rule_id, r.severity) for r in out.findings.collect())
    assert got == [("sql/a.sql", 1, "SQ0020", "warning"), ("src/A.cs", 2, "AR0070", "hint"), ("src/A.cs", 3, "AR0073", "error")]
    assert "SQ0001" in {r.rule_id for r in out.skipped.collect()}


def test_baseline_and_reports(spark):
    first = engine.check(files(spark)).findings
    accepted = first.where("rule_id = 'SQ0020'").select("fingerprint")
    again = engine.check(files(spark), None, accepted)
    assert [r.rule_id for r in again.baselined.collect()] == ["SQ0020"]
    assert "SQ0020" not in {r.rule_id for r in again.findings.collect()}
    log = json.loads("".join(reports.sarif(first, {})))
    assert len(log["runs"][0]["results"]) == first.count()
    assert all(r["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1 for r in log["runs"][0]["results"])
    text = list(reports.console(first, 1))
    assert text[-1].endswith("1 accepted before")
    assert reports.exit_code(first, "error") == 0 and reports.exit_code(first, "warning") == 1


def test_fingerprints_survive_shifted_lines(spark):
    prints = lambda text: sorted(r.fingerprint for r in engine.check(spark.createDataFrame([(1, "a.sql", "sql", text)], "file_id long, path string, language string, text string")).findings.collect())
    assert prints(SQL) == prints("\n\n" + SQL)
    assert len(set(prints(SQL + SQL))) == 4


def test_suppression_forms(spark):
    text = "lens-ignore\nx\nlens-ignore[A1, b2]\ny\nLENS-IGNORE-FILE[C3]"
    lines = src.lines(spark.createDataFrame([(1, text)], "file_id long, text string"))
    got = {(r.line, r.rule_id) for r in fi.suppressions(lines).collect()}
    assert got == {(0, None), (1, None), (2, "A1"), (3, "A1"), (2, "B2"), (3, "B2"), (None, "C3")}


def test_config():
    c = config.parse('{"rule": {}, "rules": {"AR001": "warn", "AR0010": "loud"}, "layers": {"layers": {"web": []}, "deny": [{"from": "web", "to": "wob"}]}}')
    said = config.validate(c, rules.CATEGORIES, fi.SEVERITIES, fi.SPELLINGS)
    assert any("did you mean 'rules'" in m for m in said) and any("AR0010" in m for m in said) and any("'wob'" in m for m in said)
    assert config.parse("{").messages and config.parse("{").rules == {}
    assert config.with_severity('{ "rules": { "A": "off" } /* c */ }', "A", "hint") == '{ "rules": { "A": "hint" } /* c */ }'
    assert json.loads(config.with_severity('{ "rules": {} }', "B", "off"))["rules"] == {"B": "off"}
    assert config.nearest("archtecture", ["architecture", "async"]) == "architecture"


def test_globs_and_owners(spark):
    import re

    assert re.search(src.glob_regex("**/bin/**"), "bin/a.cs") and re.search(src.glob_regex("*.cs"), "A.CS") and not re.search(src.glob_regex("*.cs"), "a/b.cs")
    f = spark.createDataFrame([(1, "o/i/a.cs"), (2, "o/b.cs"), (3, "c.cs")], "file_id long, path string")
    p = spark.createDataFrame([("o",), ("o/i",)], "project string")
    assert {(r.file_id, r.project) for r in src.owners(f, p).collect()} == {(1, "o"), (1, "o/i"), (2, "o")}
    assert {(r.file_id, r.project) for r in src.nearest_owner(f, p).collect()} == {(1, "o/i"), (2, "o")}
    leaves = src.json_leaves(spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}]}, "d": "x"}'), (2, "{")], "file_id long, text string"))
    assert {(r.path, r.value) for r in leaves.collect()} == {("a:b:0", "1"), ("a:b:1:c", None), ("d", "x")} or {r.path for r in leaves.collect()} >= {"a:b:0", "d"}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "e")], "callee string, caller string")
    assert {(r.node, r.component, r.size) for r in graph.cycles(edges).collect()} == {(x, "a", 3) for x in "abc"}
    reach = graph.reach(spark.createDataFrame([("d",)], "key string"), edges, 2)
    assert {(r.key, r.depth) for r in reach.collect()} == {("d", 0), ("a", 1), ("e", 1), ("b", 2)}
    assert [r.root for r in graph.bounded(reach, edges, 2).collect()] == ["d"]
    many = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    assert {(r.callee, r.caller) for r in graph.trace("d", edges, many).collect()} == {("d", "a"), ("d", "e")}


def test_commands(capsys):
    assert cli.main(["rules"]) == 0 and "AR0010" in capsys.readouterr().out
    assert cli.main(["explain", "AR001"]) == 2 and "did you mean" in capsys.readouterr().err
    assert cli.main(["explain", "ar0010"]) == 0
    assert cli.main(["nonsense"]) == 2


def test_project_rules(spark):
    ref = lambda *t: "<Project><ItemGroup>" + "".join(f'<ProjectReference Include="..\\{x}\\{x}.csproj" />' for x in t) + "</ItemGroup></Project>"
    code = 'class A { A(IConfiguration c) { var a = c["Known:Key"]; var b = c["Absent"]; F(a, b); } }'
    rows = [
        (1, "a/a.csproj", "project", ref("b")), (2, "b/b.csproj", "project", ref("a", "gone")), (3, "c/c.csproj", "project", ref("a")), (4, "d/d.csproj", "project", "<Project>"),
        (5, "a/appsettings.json", "settings", '{"Known": {"Key": 1}}'), (6, "b/appsettings.Dev.json", "settings", "{"), (7, "a/x/A.cs", "csharp", code), (8, "c/B.cs", "csharp", code), (9, "a/x/appsettings.json", "settings", "{"),
    ]
    out = engine.check(spark.createDataFrame(rows, "file_id long, path string, language string, text string"))
    assert not out.failed
    got = sorted((r.path, r.rule_id) for r in out.findings.collect())
    assert got == [("a/a.csproj", "AR0040"), ("a/x/A.cs", "AR0030"), ("b/appsettings.Dev.json", "AR0031"), ("b/b.csproj", "AR0040"), ("d/d.csproj", "AR0041")]


def test_modes(spark):
    rows = [(1, "p/p.csproj", "project", "<Project/>"), (2, "p/A.cs", "csharp", CODE), (3, "p/B.cs", "csharp", CODE), (4, "q/C.cs", "csharp", CODE), (5, "p/appsettings.json", "settings", "{")]
    files = spark.createDataFrame(rows, "file_id long, path string, language string, text string")
    paths = lambda mode, target: sorted({r.path for r in engine.check(files, None, None, mode, target).findings.collect()})
    assert paths("file", "p/a.cs") == ["p/A.cs"]
    assert paths("project", "p/A.cs") == ["p/A.cs", "p/appsettings.json"]
    assert paths("project", "p/gone.cs") == ["p/A.cs", "p/B.cs", "p/appsettings.json"]
    assert paths("workspace", None) == ["p/A.cs", "p/B.cs", "p/appsettings.json", "q/C.cs"]


def test_packs_and_failures(spark, tmp_path, monkeypatch):
    (tmp_path / "good_pack.py").write_text(
        "from pyspark.sql import functions as F\nRULES = [('X1', 'mine', 'warning', 'file', 'Class is called A'), ('AR0010', 'a', 'error', 'file', 't'), ('X2', '', 'hint', 'file', 't')]\n"
        "def find(nodes, items, options):\n    t = nodes.where(\"kind = 'Type' and name = 'A'\")\n    return t.select('file_id', F.explode(F.array(F.lit('X1'), F.lit('X9'))).alias('rule_id'), F.lit('m').alias('message'), F.col('start_line').alias('line'), F.col('start_col').alias('col'))\n"
    )
    (tmp_path / "bad_pack.py").write_text("from pyspark.sql import functions as F\nRULES = [('Y1', 'mine', 'warning', 'file', 'Fails')]\ndef find(nodes, items, options):\n    return nodes.select('file_id', F.lit('Y1').alias('rule_id'), F.raise_error(F.lit('boom')).cast('string').alias('message'), F.lit(0).alias('line'), F.lit(0).alias('col'))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    c = config.Config(rule_packs=["good_pack", "bad_pack", "no_such_pack", "json"], options={"SQ0011": {"pattern": "("}, "AR0060": {"threshold": "many"}})
    out = engine.check(files(spark), c)
    found = {r.rule_id for r in out.findings.collect()}
    assert "X1" in found and "X9" not in found and "AR0070" in found
    assert [i for i, _ in out.failed] == ["Y1"]
    assert {r.rule_id for r in out.skipped.where("reason like 'failed: %'").collect()} == {"Y1"}
    assert len(out.diagnostics) == 4


def test_unreadable_bytes(spark, tmp_path):
    (tmp_path / "A.cs").write_bytes(b"\xef\xbb\xbfclass A { } // \xff\xfe")
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "B.cs").write_text("class B { }")
    got = src.read_workspace(spark, str(tmp_path)).collect()
    assert [(r.path, r.language) for r in got] == [("A.cs", "csharp")] and got[0].text.startswith("class A")
