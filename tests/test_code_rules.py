import pytest

from tessera.operators import code_rules as r
from tessera.parse import csharp, nodes, tsql

CODE = {
    1: """using System.Data;
namespace Shop.Web {
  public class OrderService {
    public int Count; public readonly int Fine = 1; private string _password = "hunter2";
    public async void Bad() { await Go(); }
    async void Click(object sender, ClickEventArgs e) { await Go(); }
    public async Task Go() { FooAsync(); var x = task.Result; Thread.Sleep(5); try { Go(); } catch (Exception e) { throw e; } try { Go(); } catch { } }
    bool Any(List<int> xs) { string s = ""; foreach (var i in xs) { s += i; } if (xs.Count() > 0 && true) return xs.ToList().Any(); return s == s; }
    void Sql(SqlConnection c, string name) { var cmd = new SqlCommand("select * from t where n='" + name + "'"); cmd.CommandText = $"delete {name}"; var q = "SELECT * FROM orders"; Console.WriteLine(q.ToUpper()); cmd.Dispose(); var leak = new FileStream("a"); }
    void Unused(int p, int used) { int z = used; var token = new Random(); var h = MD5.Create(); var re = new Regex("(a+)+$"); var url = "https://api.shop.io/x"; if (true) { } }
    void Dup() { A("duplicate text"); A("duplicate text"); A("duplicate text"); }
    int Deep(int a) { if (a > 0) { for (;;) { while (a > 1) { if (a == 2 && a < 3 || a > 4) { return Deep(a); } else if (a == 5) { } else { } } } } return a > 1 ? 1 : 2; }
  }
}""",
    2: """namespace Shop.Data { using Shop.Web; class Store { public Store(IScoped s, IMissing m) {} Shop.Web.X f; }
 class Startup { void Configure(IServiceCollection s) { s.AddSingleton<IStore, Store>(); s.AddScoped<IScoped, Scoped>(); } } }""",
    3: "class Broken { void F( { if x ] } string s = \"unterminated",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nodes"))
    nodes.csharp_nodes(spark.createDataFrame(list(CODE.items()), "file_id long, text string")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_plain_rules(tree):
    got = {(x.file_id, x.rule_id, x.line) for x in r.all_plain(tree).collect() if x.file_id < 3}
    want = {
        (1, "AR0075", 3), (1, "AR0050", 3), (1, "AR0012", 4), (1, "SVC0020", 4), (1, "AR0011", 6), (1, "AR0010", 6), (1, "AR0015", 6), (1, "AR0014", 6), (1, "AR0013", 6),
        (1, "AR0021", 7), (1, "AR0020", 7), (1, "AR0022", 7), (1, "AR0072", 7), (1, "AR0054", 8), (1, "AR0073", 8), (1, "AR0074", 8), (1, "AR0071", 8),
        (1, "AR0071", 6), (1, "AR0070", 8), (1, "AR0070", 9), (1, "AR0071", 9), (1, "AR0052", 9), (1, "AR0051", 9), (1, "AR0053", 9), (1, "SVC0010", 9), (1, "AR0072", 9), (1, "AR0061", 10), (1, "AR0060", 11),
        (2, "AR0002", 1), (2, "AR0005", 1), (2, "AR0070", 0),
    }
    assert got == want
    assert (1, "SVC0020", 6) not in got
    assert (1, "AR0012", 5) not in got


def test_complexity_score(tree):
    score = {x.method: x.score for x in r.complexity(tree.where("file_id = 1")).collect()}
    deep = tree.where("file_id = 1 and kind = 'Method' and name = 'Deep'").first().node
    # if 1, for 2, while 3, if 4, chain of three operators of two kinds 2, recursion 1, else if 4, else 1, ternary 1
    assert score[deep] == 19


def test_layers(spark, tree):
    pre = spark.createDataFrame([("Shop.Web", "web", 0), ("Shop.Data", "data", 1)], "prefix string, layer string, ord int")
    got = {(x.file_id, x.line) for x in r.layers(tree, pre, [("data", "web")], False).collect()}
    assert got == {(2, 0)}
    assert r.layers(tree, pre, [("data", "web")], True).count() == 0


def test_inline_sql(spark, tree):
    literals, items = r.embedded_sql(tree, nodes.sql_items)
    assert {x.line for x in r.inline_star(literals, items).collect()} == {8}
    ddl = nodes.sql_items(spark.createDataFrame([(1, "CREATE TABLE dbo.Orders (Id INT, Total MONEY)")], "file_id long, text string"))
    code = spark.createDataFrame([(9, 'class A { string q = "SELECT Id, Missing FROM orders"; string p = "select a from elsewhere"; }')], "file_id long, text string")
    lit, it = r.embedded_sql(nodes.csharp_nodes(code), nodes.sql_items)
    assert [x.message for x in r.unknown_columns(lit, it, r.catalog(ddl)).collect()] == ["'dbo.orders' has no column 'Missing'"]


def test_sql_rules(spark):
    text = "SELECT * FROM a WITH (NOLOCK) WHERE x = NULL;\nDELETE FROM t;\nUPDATE t SET a = 1;\nDELETE FROM #t;\nCREATE TABLE #bad (i INT);\nGO\nCREATE PROCEDURE run_it AS SELECT COUNT(*), '* from' FROM b"
    items = nodes.sql_items(spark.createDataFrame([(1, text), (2, "SELECT FROM a"), (3, None)], "file_id long, text string"))
    got = sorted((x.file_id, x.rule_id, x.line) for x in r.sql_rules(items, "forbidden", "^#tmp", "^usp_").collect())
    assert got == [(1, "SQ0001", 0), (1, "SQ0010", 0), (1, "SQ0011", 4), (1, "SQ0012", 6), (1, "SQ0020", 1), (1, "SQ0020", 2), (1, "SQ0021", 0), (2, "SQ0002", 0)]


def test_settings_keys(spark, tree):
    code = spark.createDataFrame([(1, 'class A { A(IConfiguration c) { var a = c["Known:Key"]; var b = c["Absent"]; c.GetSection("Known"); c.GetConnectionString("Main"); } }')], "file_id long, text string")
    own = spark.createDataFrame([(1, "p")], "file_id long, project string")
    settings = spark.createDataFrame([("p", "Known:Key"), ("p", "Other")], "project string, path string")
    got = sorted(x.message for x in r.unknown_keys(nodes.csharp_nodes(code), own, settings).collect())
    assert got == ["unknown setting 'Absent'", "unknown setting 'ConnectionStrings:Main'"]


def test_call_graph(tree):
    edges = {(x.callee, x.caller) for x in r.call_edges(tree.where("file_id = 1")).collect()}
    assert {("Go/0", "Bad/0"), ("Deep/1", "Deep/1"), ("SqlCommand/1", "Sql/2"), ("Result/0", "Go/0")} <= edges


def test_long_chains_and_failing_files(spark):
    n = 10_000
    deep = [
        "class A { int F() { return " + " + ".join(["1"] * n) + "; } }",
        "class A { int F() { return x" + ".G()" * n + "; } }",
        "class A { bool F() { return " + " && ".join(["a"] * n) + "; } }",
        "class A { int F() { return " + "(" * 2000 + "1" + ")" * 2000 + "; } }",
        "class A { void F() { " + "if (a) { " * 1000 + "G();" + " }" * 1000 + " } }",
        "class B { async void Bad() { } }",
    ]
    found = nodes.csharp_nodes(spark.createDataFrame(list(enumerate(deep)), "file_id long, text string")).cache()
    assert {x.file_id for x in found.where("kind = 'Type'").collect()} == set(range(6))
    assert [x.file_id for x in r.async_void(found).collect()] == [5]
    items = nodes.sql_items(spark.createDataFrame([(1, "SELECT " + "(" * 1500 + "1" + ")" * 1500), (2, "DELETE FROM t")], "file_id long, text string"))
    assert [x.file_id for x in items.where("kind = 'Delete'").collect()] == [2]

    def broken(file_id, text):
        raise RecursionError("too deep")

    assert nodes.guarded(broken, lambda i, why: (i, why))(7, "") == [(7, "RecursionError: too deep")]


def test_long_receivers_are_seen(tree, spark):
    chain = "x" + ".Where(a => a > 1)" * 40
    code = f"class A {{ bool F() {{ return {chain}.Count() > 0; }} bool G() {{ return {chain}.ToList().Any(); }} }}"
    got = {x.rule_id for x in r.all_plain(nodes.csharp_nodes(spark.createDataFrame([(1, code)], "file_id long, text string"))).collect()}
    assert {"AR0020", "AR0022"} <= got


def test_parsers_never_fail():
    for text in ["", "}", "class", "((((", 'x = $"{a', "/*", "'", "@", "#if x", "a ? b : c ? d", "switch (x) { case", "😀", "class A { void F() { if (a) else b } "]:
        assert csharp.parse(text).kind == "CompilationUnit"
        tsql.parse(text)
