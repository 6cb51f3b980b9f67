import pytest

from tessera.parse import tsql

GOOD = [
    "MERGE dbo.T AS t USING (SELECT a, b FROM s) AS s ON t.id = s.id WHEN MATCHED AND s.x > 1 THEN UPDATE SET t.a = s.a, b = CASE WHEN s.b = 1 THEN 2 ELSE 3 END WHEN NOT MATCHED BY TARGET THEN INSERT (id, a) VALUES (s.id, s.a) WHEN NOT MATCHED BY SOURCE THEN DELETE OUTPUT $action, inserted.id;",
    "WITH c AS (SELECT 1 AS a) MERGE INTO T WITH (HOLDLOCK) USING c ON T.a = c.a WHEN MATCHED THEN DELETE;\nSELECT a FROM b",
    "MERGE TOP (10) T USING s ON T.a = s.a WHEN NOT MATCHED THEN INSERT DEFAULT VALUES OPTION (RECOMPILE);",
    "SELECT a FROM t TABLESAMPLE (10 PERCENT) REPEATABLE (5) WHERE b = 1",
    "SELECT a FROM t AS x TABLESAMPLE SYSTEM (10)",
    "SELECT [1], [2] FROM (SELECT a, k FROM t) AS s PIVOT (SUM(a) FOR k IN ([1], [2])) AS p WHERE [1] > 0",
    "SELECT k, v FROM t UNPIVOT (v FOR k IN (a, b)) AS u ORDER BY k",
    "SELECT a AT TIME ZONE 'UTC' AS b FROM t WHERE c AT TIME ZONE 'UTC' > d ORDER BY a AT TIME ZONE 'UTC'",
    "SELECT PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY a) OVER (PARTITION BY b) AS m FROM t GROUP BY b",
    "UPDATE STATISTICS dbo.T;\nSELECT 1",
    "UPDATE STATISTICS dbo.T ix WITH FULLSCAN, NORECOMPUTE\nSELECT 1",
    "UPDATE t SET a = CASE b WHEN 1 THEN (CASE WHEN c = 1 THEN 1 WHEN c = 2 THEN 3 END) END WHERE d = 1",
]
BAD = ["MERGE T USING s WHEN MATCHED THEN DELETE;", "MERGE T USING s ON T.a = s.a;", "MERGE T USING s ON a = b WHEN MATCHED THEN UPDATE;", "SELECT a FROM t PIVOT", "UPDATE t SET"]


@pytest.mark.parametrize("text", GOOD)
def test_forms_that_parse(text):
    items, error = tsql.parse(text)
    assert error is None
    # no part of a merge is a statement of its own, and statistics aren't rows
    assert not [x for x in items if x.kind in ("Update", "Delete") and not x.where]


@pytest.mark.parametrize("text", BAD)
def test_forms_that_do_not(text):
    assert tsql.parse(text)[1] is not None
