from tessera.sources import projects
from tessera.streaming import incremental


def test_projects_and_snippets(spark):
    p = spark.createDataFrame([("a/x/x.csproj", '<Project><ItemGroup><ProjectReference Include="..\\y\\y.csproj" /></ItemGroup></Project>'), ("b.csproj", "<Project><Item>")], "path string, text string")
    read = projects.parsed(p)
    assert [(r.project, r.target) for r in projects.references(read).collect()] == [("a/x/x.csproj", "a/y/y.csproj")]
    assert [r.path for r in read.where("error is not null").collect()] == ["b.csproj"]
    text = "# t\n### P-1 · First\n```csharp\nvar x = 1;\nvar y;\n```\nwords\n```sql\nSELECT 1\n```\n### P-2 · Next\n```csharp\nz\n```"
    got = {(r.snippet_id, r.ordinal, r.language, r.text) for r in projects.snippets(spark.createDataFrame([(1, text)], "file_id long, text string")).collect()}
    assert got == {("P-1", 0, "csharp", "var x = 1;\nvar y;"), ("P-1", 1, "sql", "SELECT 1"), ("P-2", 0, "csharp", "z")}


def test_incremental(spark):
    cols = "file_id long, path string, language string, text string"
    files = spark.createDataFrame([(1, "a.sql", "sql", "SELECT * FROM a"), (2, "b.sql", "sql", "SELECT 1")], cols)
    new = incremental.overlaid(files, spark.createDataFrame([(1, "a.sql", "sql", "SELECT 2")], cols))
    todo, gone = incremental.delta(new, incremental.versions(files))
    assert [r.path for r in todo.collect()] == ["a.sql"] and gone.count() == 1
