import contextlib
import io
import random
import re

import pytest

from tessera import common
from tessera.operators import code_rules as r
from tessera.parse import nodes
from tessera.plans import code_cases
from tests.test_code_rules import CODE


@pytest.fixture(scope="module")
def tree(spark):
    return nodes.tree_of(spark.createDataFrame(list(CODE.items()), "file_id long, text string"))


@pytest.mark.parametrize("rule", [r.unused_parameters, r.unused_locals, r.undisposed, r.async_void, r.rethrow, r.too_complex])
def test_rules_need_no_exchange_and_read_few_columns(spark, tree, rule):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            rule(tree).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = out.getvalue()
    assert "Exchange" not in plan
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan)
    assert schemas and all(len(s.split(",")) <= 14 and "text:" not in s for s in schemas)


def test_files_are_parsed_in_as_many_tasks_as_there_are_buckets(spark):
    files = spark.createDataFrame([(i, f"class A{i} {{ async void M() {{ }} }}") for i in range(60)], "file_id long, text string").coalesce(1)
    tree = nodes.tree_of(files)
    assert len(tree.inputFiles()) == 8
    assert sorted(x.file_id for x in r.async_void(tree).collect()) == list(range(60))


def test_next_use_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for f in range(6):
        for _ in range(150):
            name, at = rng.choice("abc") if f else "a", rng.randrange(200)
            rows.append((f, name, at, at, None) if rng.random() < 0.6 else (f, name, at, None, at + rng.randrange(60)))
    events = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "file_id long, name string, at int, use int, until int, id int")
    want = {i for i, (f, n, at, use, until) in enumerate(rows) if until is not None and not any(g == f and m == n and u is not None and at <= u <= until for g, m, _, u, _ in rows)}
    assert {x.id for x in r.unused(events).collect()} == want


def test_a_name_that_occurs_very_often(spark):
    n = 3000
    code = "class A { " + " ".join(f"void M{i}(int x, int y) {{ F(x); }}" for i in range(n)) + " }"
    found = r.unused_parameters(nodes.tree_of(spark.createDataFrame([(1, code)], "file_id long, text string")))
    assert found.count() == n


@pytest.mark.parametrize("rule", list(r.READS))
def test_what_a_rule_reads_is_enough(spark, rule):
    texts = list(CODE.values()) + [case.between.join((case.around[0], *case.breaks, *case.keeps, case.around[1])) for case in (*code_cases.PLAIN_CASES, code_cases.LAYER_CASE)]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    prefixes = spark.createDataFrame([("Shop.Web", "web", 0), ("Shop.Data", "data", 1)], "prefix string, layer string, ord int")
    found = lambda tree: sorted(map(tuple, (rule(tree, prefixes, [("web", "data"), ("data", "web")], False) if rule is r.layers else rule(tree)).collect()))
    narrow = nodes.tree_of(files, r.READS[rule])
    assert len(narrow.columns) < 28 and narrow.count() < nodes.tree_of(files).count()
    assert found(narrow) == found(nodes.tree_of(files)) != []


def test_more_text_makes_more_buckets(spark, monkeypatch):
    files = spark.createDataFrame([(i, f"class A{i} {{ async void M() {{ }} }}") for i in range(600)], "file_id long, text string")
    assert len(nodes.tree_of(files).inputFiles()) == 8
    monkeypatch.setattr(common, "BUCKET_TEXT", 1000)
    tree = nodes.tree_of(files)
    assert len(tree.inputFiles()) == common.buckets_of(files) > 8
    assert sorted(x.file_id for x in r.async_void(tree).collect()) == list(range(600))


def test_layers_meet_their_settings_without_an_exchange(spark):
    prefixes = spark.createDataFrame([("Shop.Web", "web", 0), ("Shop.Data", "data", 1)], "prefix string, layer string, ord int")
    tree = nodes.tree_of(spark.createDataFrame(list(CODE.items()), "file_id long, text string"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        r.layers(tree, prefixes, [("data", "web")], False).explain()
    assert "Exchange hashpartitioning" not in out.getvalue()


def test_a_rule_alone_asks_for_its_own_predicates(spark):
    tree = nodes.csharp_nodes(spark.createDataFrame(list(CODE.items()), "file_id long, text string"))
    whole, alone = r.single_node(tree), r.single_node(tree, rule="AR0015")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, whole.where("rule_id = 'AR0015'").collect())) != []
    assert "Sleep" in alone._jdf.queryExecution().toString() and "GetAwaiter" not in alone._jdf.queryExecution().toString()


@pytest.mark.parametrize("rule", [r.unused_locals, r.undisposed, r.count_compared, r.concat_in_loop, r.too_complex])
def test_no_side_that_grows_is_broadcast(tree, rule):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        rule(tree).explain()
    assert "Broadcast" not in out.getvalue() and "Exchange" not in out.getvalue()
