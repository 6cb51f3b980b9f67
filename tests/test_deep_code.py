import time

import pytest

from tessera import config as cfg
from tessera.parse import csharp, nodes
from tessera.sources import files as src


@pytest.mark.parametrize("opens", ["(", "f(", "((int)", "(x, "])
def test_brackets_in_brackets_take_time_in_proportion(opens):
    def seconds(n):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            with nodes.deep():
                csharp.parse("class A { object F() { return " + opens * n + "1" + ")" * n * opens.count("(") + "; } }")
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(3200) < 4 * 4 * max(seconds(800), 0.005)


def test_lambdas_casts_and_tuples_are_told_apart():
    text = "class A { void F() { var f = (a, (int b, int c)) => (int)(a + (b)); (int x, string y) t = ((int, string))(1, g((x) => x)); var u = (v)(w); var z = (p) + q; } }"
    kinds = [r[5] for r in nodes.rows(1, text)]
    assert kinds.count("Lambda") == 2 and kinds.count("Cast") == 2


def test_owner_by_prefix(spark):
    files = spark.createDataFrame([(1, "src/App/a.cs"), (2, "SRC/AppTests/b.cs"), (3, "src/AppTests/deep/c.cs"), (4, "other/d.cs")], "file_id long, path string")
    own = lambda *p: {r.file_id: r.project for r in src.prefix_owner(files, spark.createDataFrame([(x,) for x in p], "project string")).collect()}
    assert own("src/App") == {1: "src/App", 2: "src/App", 3: "src/App"}
    assert own("src/App", "src/AppTests", "") == {1: "src/App", 2: "src/AppTests", 3: "src/AppTests", 4: ""}


def test_settings_that_name_what_nothing_knows():
    config = cfg.Config(rules={"ar0010": "error", "Design": "warnin"}, options={"ar0010": {}, "AR9999": {}}, layers={"layers": {"Web": ["A"]}, "deny": [{"from": "web", "to": ""}]})
    said = cfg.validate(config, {"AR0010": "design"}, ("off", "warning", "error"), {})
    assert len(said) == 4 and any("did you mean 'warning'" in x for x in said) and any("AR9999" in x for x in said)
    assert any("the layer is 'Web'" in x for x in said) and any("no 'to'" in x for x in said)
    alone = cfg.validate(cfg.Config(layers={"allow": [{"from": "a", "to": "b"}]}), {}, ("off",), {})
    assert len(alone) == 1 and "no layers" in alone[0]
