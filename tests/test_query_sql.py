"""Queries over customers made here, held against their SQL."""

import duckdb
import pytest

from tessera.plans import registry


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """All lines of all parities, with keys far apart."""
    d = str(tmp_path_factory.mktemp("customers"))
    keys = [(k + shift, n) for shift in (0, 10_000_000) for k in range(10) for n in range(4)]
    rows = [(k * 4 + n, n) for k, n in keys]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{d}/customer.parquet")
    return d


def differs(spark, d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{d}/customer.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, d)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert want
    return sorted(tuple(r) for r in got.collect()) != sorted(want)


def test_statements_are_counted_as_the_sql_counts_them(spark, customers):
    assert not differs(spark, customers, "parse_sql_items")
