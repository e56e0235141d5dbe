"""The numbered queries that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from cohortlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(name, spark, sf):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(c) for c in columns]
    wanted = sorted((tuple(row[i] for i in order) for row in found.fetchall()), key=str)
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == columns
    assert sorted((tuple(row) for row in df.select(*columns).collect()), key=str) == wanted
