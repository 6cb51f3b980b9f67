"""What makes large checks cheaper, and that it leaves their results as they are."""

from tessera import engine
from tessera.config import Config
from tessera.operators import fused
from tessera.parse import nodes
from tests.test_code_rules import CODE
from tests.test_fused import MORE


def test_copies_of_a_text_are_parsed_once_and_all_get_their_rows(spark, monkeypatch):
    texts = [*CODE.values(), *MORE.values()]
    files = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(3 * len(texts))] + [(1000, None)], "file_id long, text string").coalesce(1)
    rows = lambda df: sorted(map(str, df.collect()))
    got = rows(nodes.csharp_nodes(files))
    monkeypatch.setattr(nodes, "REMEMBERED", 0)
    assert got == rows(nodes.csharp_nodes(files))
    monkeypatch.setattr(nodes, "REMEMBERED", 2000)
    # each call of the parser for a file of its own leaves a row of its own
    calls = lambda i, text: [(i, i, text)]
    made = nodes._table(spark.createDataFrame([(i, f"t{i % 3}") for i in range(30)], "file_id long, text string").coalesce(1), calls, "file_id long, by long, text string")
    assert sorted(r.file_id for r in made.collect()) == list(range(30))
    assert {r.by for r in made.collect()} == {0, 1, 2}


def test_conditions_of_marks_are_not_interpreted_in_a_generator(spark):
    tree = nodes.tree_of(spark.createDataFrame(list(CODE.items()), "file_id long, text string"))
    plan = fused.marks(tree, set(fused.RULES), (), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.split("\n") if "Generate explode(_marks" in line] and "explode(CASE" not in plan


def test_a_check_reads_few_columns_and_misses_none(spark):
    files = spark.createDataFrame([(i, f"a/F{i}.cs", "csharp", text) for i, text in (CODE | MORE).items()], "file_id long, path string, language string, text string")
    layers = {"layers": {"web": ["Shop.Web"], "data": ["Shop.Data"]}, "deny": [{"from": "web", "to": "data"}]}
    config = Config(options={"ACME0002": {"namespaces": ["Banned"]}}, layers=layers)
    narrow = engine.check(files, config)
    whole = engine.READS
    try:
        engine.READS = None
        wide = engine.check(files, config)
    finally:
        engine.READS = whole
    assert narrow.failed == wide.failed == []
    rows = lambda r: sorted(map(str, r.findings.select("path", "rule_id", "message", "line", "col", "fingerprint").collect()))
    assert rows(narrow) == rows(wide) != []
    assert "end_col" not in whole.columns and "end_line" not in whole.columns
