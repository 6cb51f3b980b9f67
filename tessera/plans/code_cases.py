"""Queries that run the rules over code made from the customers, with SQL that knows what they find.

A file is made for each customer: a line for each of its ``2 + c_nationkey % 4`` cases (or one), between a head and a tail.
Line i breaks the rule if ``c_custkey + i`` is even and keeps it otherwise, in one of several wordings each. ``{i}`` and
``{id}`` stand for the line and the customer. The parser, the node table and the shipped rule run over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.common import by_file, saved
from tessera.operators import code_rules as code
from tessera.operators import fused
from tessera.parse import nodes as trees
from tessera.plans.tables import table

CLASS = ("class A {\n", "\n}")


@dataclass(frozen=True)
class Case:
    rule: str
    breaks: tuple[str, ...]
    keeps: tuple[str, ...]
    around: tuple[str, str] = CLASS
    between: str = "\n"
    single: bool = False

    def lines(self) -> tuple[int, int]:
        """Line of the first case, and lines from one case to the next."""
        return self.around[0].count("\n"), self.between.count("\n")

    def sql(self) -> str:
        first, step = self.lines()
        n = "1" if self.single else "2 + c_nationkey % 4"
        return f"SELECT c_custkey AS file_id, '{self.rule}' AS rule_id, CAST({first} + {step} * i AS BIGINT) AS line FROM customer, range(0, 5) t(i) WHERE i < {n} AND (c_custkey + i) % 2 = 0"


def body(*texts: str, result: str = "void", parameters: str = "") -> tuple[str, ...]:
    return tuple(f"{result} M{{i}}({parameters}) {{ {t} }}" for t in texts)


def nested(depth: int) -> str:
    return "void M{i}(bool a) { " + "if (a) { " * depth + "F();" + " }" * depth + " }"


def registered(consumer: str, needed: str | None) -> str:
    """A service that needs another one, and how long each lives."""
    other = f" s.Add{needed}<ID{{id}}_{{i}}, D{{id}}_{{i}}>();" if needed else ""
    return f"class S{{id}}_{{i}} {{ public S{{id}}_{{i}}(ID{{id}}_{{i}} d) {{ }} }} class R{{i}} {{ void C(X s) {{ s.Add{consumer}<IS{{id}}_{{i}}, S{{id}}_{{i}}>();{other} }} }}"


PLAIN_CASES = (
    Case("AR0010", ("int M{i}() { return LoadAsync().Result; }", "void M{i}() { LoadAsync().Wait(); }", "int M{i}() { return Go().GetAwaiter().GetResult(); }"), ("int M{i}(X x) { return x.Result; }", "async Task M{i}(X x) { x.Result(); }", "void M{i}(X x) { x.Wait(5); }")),
    Case("AR0011", body("SaveAsync();", "this.x.SaveAsync(1);"), ("async Task M{i}() { await SaveAsync(); }", "void M{i}() { var t = SaveAsync(); }", "void M{i}() { Save(); }")),
    Case("AR0012", ("async void M{i}() { }", "public async void M{i}(int a) { }"), ("async void M{i}(object s, ClickEventArgs e) { }", "async Task M{i}() { }", "void M{i}() { }")),
    Case("AR0013", body("try { F(); } catch { }", "try { F(); } catch (Exception e) { /* none */ }"), body("try { F(); } catch { G(); }", "F();")),
    Case("AR0014", body("try { F(); } catch (Exception e) { throw e; }"), body("try { F(); } catch (Exception e) { throw; }", "try { F(); } catch (Exception e) { throw new X(e); }")),
    Case("AR0015", ("async Task M{i}() { Thread.Sleep(5); }", "async Task M{i}() { System.Threading.Thread.Sleep(5); }"), ("void M{i}() { Thread.Sleep(5); }", "async Task M{i}() { Clock.Sleep(5); }")),
    Case("AR0020", body("return x.Count() > 0;", "return x.Count() == 0;", "return x.Y().Count() >= 1;", result="bool", parameters="L x"), body("return x.Count > 0;", "return x.Count() > 1;", "return x.Count(p) > 0;", result="bool", parameters="L x")),
    Case("AR0021", body('string s{i} = ""; while (F()) { s{i} += "a"; }', 'string s{i} = ""; foreach (var x in y) { if (x) { s{i} += x; } }'), body("int n{i} = 0; while (F()) { n{i} += 1; }", 'string t{i} = ""; t{i} += "a";', 'var u{i} = ""; for (;;) { u{i} += "a"; }')),
    Case("AR0022", body("return x.ToList().Any();", "return x.ToArray().Count();", result="bool", parameters="L x"), body("return x.Any();", "return x.ToList().Foo();", "return x.ToList(c).Any();", result="bool", parameters="L x")),
    Case("AR0050", ('string password{i} = "hunter2";', 'void M{i}() { this.apiKey = "k1"; }', 'void M{i}() { var clientSecret = "abc"; }'), ('string password{i} = "";', 'string name{i} = "hunter2";', "string token{i} = Load();")),
    Case("AR0051", body("var h = MD5.Create();", "var h = new SHA1CryptoServiceProvider();", "var h = System.Security.Cryptography.DES.Create();"), body("var h = SHA256.Create();", "var h = new Md5();")),
    Case("AR0052", body("var token = new Random();", "Random passwordSeed = new Random(1);"), body("var dice = new Random();", "var token = Next();")),
    Case("AR0053", body('var r = new Regex("(a+)+$");', 'Regex.IsMatch(x, "(b*)*");', 'Regex.Replace(x, "([a-z]+x)*", y);'), body('var r = new Regex("(ab)+");', 'Foo("(a+)+");', 'var r = new Regex("[(a+)+]");')),
    Case("AR0054", body('var c = new SqlCommand("select " + n);', 'c.CommandText = $"delete {n}";', 'db.ExecuteSqlRaw("x" + n);', parameters="string n"), body('var c = new SqlCommand("select 1");', 'var c = new SqlCommand("a" + "b");', 'c.CommandText = "delete";', parameters="string n")),
    Case("AR0060", (nested(6),), (nested(5), "void M{i}() { F(); }")),
    Case("AR0070", ("void M{i}(int p) { }", "int M{i}(int p) { return q; }"), ("void M{i}(int p) { F(p); }", "void M{i}(int _p) { }", "public override void M{i}(int p) { }")),
    Case("AR0071", body("int z = 1;", "var z = F(); { G(y); }"), body("int z = 1; F(z);", "const int z = 1;", "using var z = F();")),
    Case("AR0072", ("bool M{i}(int a) { return a == a; }", "void M{i}() { if (true) { F(); } }", "int M{i}() { return false ? 1 : 2; }"), ("bool M{i}(int a, int b) { return a == b; }", "void M{i}() { if (F()) { G(); } }", "bool M{i}(int a) { return a != a; }")),
    Case("AR0073", body('Console.WriteLine("x");', 'Console.Error.Write("x");', 'System.Console.Out.WriteLine("x");'), body('Log.WriteLine("x");', "Console.ReadLine();")),
    Case("AR0074", body('var s = new FileStream("a");', 'var s = new StreamReader("a"); s.Read();'), body('using var s = new FileStream("a");', 'var s = new FileStream("a"); s.Dispose();', 'var s = new FileStream("a"); F(s);')),
    Case("AR0075", ("public int F{i};", "public string F{i} = G();"), ("public readonly int F{i} = 1;", "private int F{i};", "public const int F{i} = 1;")),
    Case("AR0090", ('string M{i}() { return "x".ToUpper(); }', "string M{i}(string t{i}) { return t{i}.ToLower(); }"), ('string M{i}() { return "x".ToUpperInvariant(); }', "string M{i}() { return x.ToUpper(c); }", "string M{i}(Text v{i}) { return v{i}.ToUpper(); }")),
    Case("ACME0001", body("var h = new HttpClient();"), body("var h = new System.Net.Http.HttpClient();", "var h = new HttpClientHandler();")),
    Case("SVC0001", body("var d = DateTime.Now;", "var d = System.DateTime.Today;", "var d = DateTimeOffset.Now;"), body("var d = DateTime.UtcNow;", "var d = DateTimeOffset.Today;", "var d = Clock.Now;")),
    Case("SVC0002", body("var c = CultureInfo.CurrentCulture;", "F(System.Globalization.CultureInfo.CurrentUICulture);"), body("var c = CultureInfo.InvariantCulture;", "var c = Thread.CurrentCulture;")),
    Case("SVC0003", body("var d = Directory.GetCurrentDirectory();"), body("var d = Directory.Exists(x);", "var d = Env.GetCurrentDirectory();")),
    Case("SVC0010", ('string u{i} = "https://api.shop.io/x";', 'void M{i}() { host = "10.0.0.1"; }', 'string u{i} = @"\\\\files\\share";'), ('string u{i} = "http://localhost/x";', 'string u{i}Pattern = "https://a.b";', 'string u{i} = "999.0.0.1";')),
    Case("SVC0020", ("async Task M{i}() { await G(); }", "async Task<int> M{i}(int a) { return await G(a); }"), ("async Task M{i}Async() { await G(); }", "[Fact] public async Task M{i}() { await G(); }", "public override async Task M{i}() { await G(); }")),
    Case("AR0002", (registered("Singleton", "Scoped"),), (registered("Scoped", "Scoped"), registered("Singleton", "Transient"), registered("Scoped", "Singleton")), ("", "")),
    Case("AR0003", (registered("Singleton", "Transient"),), (registered("Transient", "Transient"), registered("Scoped", "Transient")), ("", "")),
    Case("AR0004", (registered("Scoped", "Transient"),), (registered("Singleton", "Singleton"), registered("Singleton", "Transient")), ("", "")),
    Case("AR0005", (registered("Singleton", None),), (registered("Singleton", "Singleton"),), ("", "")),
)

USING = ("", "\nnamespace Shop.Web { class A { } }")
LAYER_CASE = Case("AR0001", ("using Shop.Data;", "using Shop.Data.Orders{i};"), ("using Shop.Web.Pages;", "using Shop.Database;", "using D{i} = Shop.Data;", "using System;"), USING)
NAMESPACE_CASE = Case("ACME0002", ("using Banned;", "using Banned.Sub{i};"), ("using Banneder;", "using Other.Banned;"), USING)
STAR_CASE = Case("AR0023", body('return "SELECT * FROM orders";', 'return "select o.* from orders o";', result="string"), body('return "SELECT Id FROM orders";', 'return "select * from";', 'return "SELECT COUNT(*) FROM orders";', result="string"))
COLUMN_CASE = Case("AR0080", body('return "SELECT Missing FROM orders";', 'return "INSERT INTO dbo.Orders (Id, Wrong) VALUES (1, 2)";', 'return "UPDATE orders SET Absent = 1";', result="string"), body('return "SELECT Id, Total FROM orders";', 'return "SELECT Other FROM elsewhere";', 'return "UPDATE orders SET Total = 1";', result="string"))
KEY_CASE = Case("AR0030", ('void M{i}(IConfiguration c) { var x = c["Absent{i}"]; }', 'void M{i}(IConfiguration c) { c.GetConnectionString("Other"); }', 'void M{i}(IConfiguration c) { c.GetSection("Known:Nothing"); }'), ('void M{i}(IConfiguration c) { var x = c["Known:Key"]; }', 'void M{i}(IConfiguration c) { c.GetSection("known"); }', 'void M{i}(IConfiguration c) { c.GetConnectionString("Main"); }'))

TEXT = ("", "")
SQL_CASES = (
    Case("SQ0001", ("SELECT * FROM t{i};", "SELECT t.* FROM t{i} t;"), ("SELECT COUNT(*) FROM t{i};", "SELECT '* from' FROM t{i};", "SELECT a FROM t{i}; -- *", "SELECT [1] FROM (SELECT a, k FROM t{i}) AS s PIVOT (SUM(a) FOR k IN ([1], [2])) AS p;", "SELECT a AT TIME ZONE 'UTC' AS b FROM t{i} TABLESAMPLE (10 PERCENT);"), TEXT),
    Case("SQ0002", ("SELECT FROM a",), ("SELECT a FROM b", "SELECT 1"), TEXT, single=True),
    Case("SQ0010", ("SELECT a FROM t{i} WITH (NOLOCK);",), ("SELECT a FROM t{i};",), TEXT),
    Case("SQ0011", ("CREATE TABLE #bad{i} (a INT);",), ("CREATE TABLE #tmp{i} (a INT);", "CREATE TABLE bad{i} (a INT);"), TEXT),
    Case("SQ0012", ("CREATE PROCEDURE run{i} AS SELECT 1", "CREATE PROCEDURE dbo.run{i} AS SELECT 1"), ("CREATE PROCEDURE usp_run{i} AS SELECT 1",), TEXT, "\nGO\n"),
    Case("SQ0020", ("DELETE FROM t{i};", "UPDATE t{i} SET a = 1;", "UPDATE #t{i} SET a = 1;"), ("DELETE FROM #t{i};", "DELETE FROM t{i} WHERE a = 1;", "UPDATE t{i} SET a = 1 WHERE b = 2;", "MERGE INTO t{i} USING s ON t{i}.a = s.a WHEN MATCHED THEN UPDATE SET b = 1 WHEN NOT MATCHED BY SOURCE THEN DELETE;", "UPDATE STATISTICS t{i};"), TEXT),
    Case("SQ0021", ("SELECT a FROM t{i} WHERE b = NULL;", "SELECT a FROM t{i} WHERE NULL <> b;", "SELECT a FROM t{i} WHERE b != NULL;"), ("SELECT a FROM t{i} WHERE b IS NULL;", "SELECT a FROM t{i} WHERE b = 1;"), TEXT),
)


def text_of(case: Case) -> Column:
    """The text of a customer's file."""
    n = F.lit(1) if case.single else (2 + F.col("c_nationkey") % 4)

    def wording(of: tuple[str, ...], i: Column) -> Column:
        return F.element_at(F.array(*(F.lit(x) for x in of)), (i % len(of) + 1).cast("int"))

    def line(i: Column) -> Column:
        text = F.when((F.col("c_custkey") + i) % 2 == 0, wording(case.breaks, i)).otherwise(wording(case.keeps, i))
        return F.replace(F.replace(text, F.lit("{i}"), i.cast("string")), F.lit("{id}"), F.col("c_custkey").cast("string"))

    lines = F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), line), case.between)
    return F.concat(F.lit(case.around[0]), lines, F.lit(case.around[1]))


def files(spark, d, case: Case) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), text_of(case).alias("text"))


def tree(spark, d, case: Case, rule=None) -> DataFrame:
    """The node table of all files; for ``rule`` alone, what it reads."""
    return trees.tree_of(files(spark, d, case), code.READS.get(rule))


def shown(found: DataFrame, rule: str) -> DataFrame:
    return found.where(F.col("rule_id") == rule).select("file_id", "rule_id", F.col("line").cast("long").alias("line"))


#: The functions that give a rule's findings, but for those of single nodes.
SHIPPED = {
    "AR0012": code.async_void, "AR0014": code.rethrow, "AR0020": code.count_compared, "AR0021": code.concat_in_loop, "AR0052": code.weak_random, "AR0053": code.nested_quantifiers, "AR0060": code.too_complex,
    "AR0070": code.unused_parameters, "AR0071": code.unused_locals, "AR0074": code.undisposed, "AR0075": code.public_fields, "AR0090": code.culture_case, "SVC0020": code.async_names,
    "AR0002": code.captive, "AR0003": code.captive, "AR0004": code.captive, "AR0005": code.captive,
}


def plain(case: Case):
    rule = SHIPPED.get(case.rule)
    if rule is None:
        # one scan of nodes: they needn't be written
        return lambda spark, d: shown(code.single_node(trees.csharp_nodes(by_file(files(spark, d, case)), code.READS[code.single_node]), rule=case.rule), case.rule)
    return lambda spark, d: shown(rule(tree(spark, d, case, rule)), case.rule)


def sql_case(case: Case):
    return lambda spark, d: shown(code.sql_rules(trees.sql_items(by_file(files(spark, d, case))), "forbidden", "^#tmp", "^usp_"), case.rule)


def layer(spark, d):
    prefixes = spark.createDataFrame([("Shop.Web", "web", 0), ("Shop.Data", "data", 1)], "prefix string, layer string, ord int")
    return shown(code.layers(tree(spark, d, LAYER_CASE, code.layers), prefixes, [("web", "data")], False), "AR0001")


def namespace(spark, d):
    return shown(code.forbidden_namespaces(tree(spark, d, NAMESPACE_CASE), ["Banned"]), "ACME0002")


def star(spark, d):
    literals, items = code.embedded_sql(tree(spark, d, STAR_CASE), trees.items_of)
    return shown(code.inline_star(literals, items), "AR0023")


DDL = "CREATE TABLE dbo.Orders (Id INT, Total MONEY)"


def column(spark, d):
    ddl = trees.sql_items(spark.range(1).select(F.col("id").alias("file_id"), F.lit(DDL).alias("text")))
    literals, items = code.embedded_sql(tree(spark, d, COLUMN_CASE), trees.items_of)
    return shown(code.unknown_columns(literals, items, code.catalog(ddl)), "AR0080")


def settings_key(spark, d):
    """A project for each nation, with a settings file."""
    from tessera.sources.files import json_leaves

    c = table(spark, d, "customer")
    own = c.select(F.col("c_custkey").alias("file_id"), F.col("c_nationkey").cast("long").alias("project"))
    text = F.lit('{"Known": {"Key": 1, "List": [1, 2]}, "ConnectionStrings": {"Main": "x"}}')
    leaves = json_leaves(own.select(F.col("project").alias("file_id")).distinct().withColumn("text", text))
    return shown(code.unknown_keys(tree(spark, d, KEY_CASE), own, leaves.select(F.col("file_id").alias("project"), "path")), "AR0030")


#: Equal literals on ``2 + c_nationkey % 4`` lines: from three on, all but the first are found.
LITERALS = Case("AR0061", ('string M{i}() { return "the same words"; }',), ('string M{i}() { return "the same words"; }',))
LITERALS_SQL = "SELECT c_custkey AS file_id, 'AR0061' AS rule_id, CAST(1 + i AS BIGINT) AS line FROM customer, range(0, 5) t(i) WHERE i < 2 + c_nationkey % 4 AND c_nationkey % 4 > 0 AND i > 0"


def literals(spark, d):
    return shown(code.duplicate_literals(tree(spark, d, LITERALS)), "AR0061")


#: Cases of rules that are answered together; customer n has a file of case n modulo their number.
TOGETHER = (*(x for x in PLAIN_CASES if x.rule in fused.RULES), LITERALS)
TOGETHER_SQL = " UNION ALL ".join(f"SELECT * FROM ({LITERALS_SQL if x is LITERALS else x.sql()}) WHERE file_id % {len(TOGETHER)} = {i}" for i, x in enumerate(TOGETHER))


def together(spark, d):
    out = None
    for i, case in enumerate(TOGETHER):
        one = files(spark, d, case).where(F.col("file_id") % len(TOGETHER) == i).withColumn("rule", F.lit(case.rule))
        out = one if out is None else out.unionByName(one)
    out = saved(out)
    found = fused.findings(trees.tree_of(out, fused.READS)).join(out.select("file_id", F.col("rule").alias("rule_id")), ["file_id", "rule_id"])
    return found.select("file_id", "rule_id", F.col("line").cast("long").alias("line"))


def built() -> tuple[dict, dict]:
    """The queries and their SQL."""
    queries = {f"rule_{c.rule.lower()}": plain(c) for c in PLAIN_CASES} | {f"rule_{c.rule.lower()}": sql_case(c) for c in SQL_CASES}
    oracles = {f"rule_{c.rule.lower()}": c.sql() for c in (*PLAIN_CASES, *SQL_CASES)}
    for case, f in ((LAYER_CASE, layer), (NAMESPACE_CASE, namespace), (STAR_CASE, star), (COLUMN_CASE, column), (KEY_CASE, settings_key)):
        queries[f"rule_{case.rule.lower()}"], oracles[f"rule_{case.rule.lower()}"] = f, case.sql()
    queries["rule_ar0061"], oracles["rule_ar0061"] = literals, LITERALS_SQL
    queries["rules_together"], oracles["rules_together"] = together, TOGETHER_SQL
    return queries, oracles
