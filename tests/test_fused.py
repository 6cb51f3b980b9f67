import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tessera import engine
from tessera.config import Config
from tessera.operators import code_rules as r
from tessera.operators import fused
from tessera.parse import nodes
from tessera.plans import code_cases
from tests.test_code_rules import CODE

SF = "/root/testdata/sf0.001"
MORE = {
    101: "class A { void F(object s, MyEventArgs e) { } async void G(object s, MyEventArgs e) { await H(); } interface I { async Task J() { await K(); } } [HttpGet] async Task K() { await L(); } }",
    102: "class A { void F() { var a = new FileStream(1), b = new StreamReader(a); using var c = new Mutex(); var d = new Timer(() => { var e = new TcpClient(); e.Close(); }); G(d); var f = new Mutex(); f.Dispose(); } }",
    103: "class A { int _f; void F(string p, int q) { foreach (var x in y) { p += x; _f += 1; } q.ToUpper(); p.ToLower(); { int z = 1; } int z = 2; G(z); } } struct S { public int A; } class C { public static int B, D; public const int E = 1; }",
    104: "",
    105: "class A { void F(int a) => G(); void H(int _b) { } virtual void I(int c) { } abstract void J(int d); void K.L(int e) { } void M(int m) { void N(int n) { m++; } Func<int, int> o = (int p) => 1; } }",
}


@pytest.fixture(scope="module")
def tree(spark):
    """The code of the tests, and of all cases for each customer, under ids of their own."""
    files = spark.createDataFrame(list((CODE | MORE).items()), "file_id long, text string")
    for i, case in enumerate((*code_cases.PLAIN_CASES, code_cases.LITERALS)):
        files = files.unionByName(code_cases.files(spark, SF, case).select((F.col("file_id") + 1000 * (i + 1)).alias("file_id"), "text"))
    return nodes.tree_of(files)


def rows(df):
    return {tuple(x) for x in df.collect()}


def test_the_same_findings_as_rule_by_rule(tree):
    want = None
    for rule in r.PLAIN:
        if rule is not r.captive:
            want = rule(tree) if want is None else want.unionByName(rule(tree))
    want, got = rows(want), rows(fused.findings(tree))
    assert {x[1] for x in want} >= set(fused.RULES) - {"ACME0001"}
    assert got == want
    some = {"AR0070", "AR0075", "SVC0020", "AR0013"}
    assert rows(fused.findings(tree, some)) == {x for x in want if x[1] in some}
    assert rows(fused.findings(tree, ["SQ0001"])) == set()


def test_options(tree):
    assert rows(fused.findings(tree, ["AR0060"], threshold=3)) == rows(r.too_complex(tree, 3))
    assert rows(fused.findings(tree, ["AR0061"], length=3, occurrences=2)) == rows(r.duplicate_literals(tree, 3, 2))


def test_one_scan_and_no_exchange(tree):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        fused.findings(tree).explain("formatted")
    plan = out.getvalue()
    assert len(re.findall(r"ReadSchema", plan)) == 1 and "Exchange" not in plan and "Join" not in plan


def test_a_name_that_occurs_very_often(spark):
    n = 3000
    code = "class A { " + " ".join(f"void M{i}(int x, int y) {{ F(x); }}" for i in range(n)) + " }"
    found = fused.findings(nodes.tree_of(spark.createDataFrame([(1, code)], "file_id long, text string")), ["AR0070"])
    assert found.count() == n


def test_rules_run_apart_when_one_fails(spark, monkeypatch):
    files = spark.createDataFrame([(1, "a/A.cs", "csharp", "class A { void F(int x) { try { G(); } catch { } } }")], "file_id long, path string, language string, text string")
    boom = lambda *a, **k: r.found(a[0].where(F.raise_error(F.lit("boom")).isNull()), "AR0070", "")
    monkeypatch.setattr(fused, "findings", boom)
    monkeypatch.setattr(r, "unused_parameters", boom)
    out = engine.check(files, Config(rules={"AR0071": "off"}))
    assert [x.rule_id for x in out.findings.collect()] == ["AR0013"]
    assert [i for i, _ in out.failed] == ["AR0070"]
