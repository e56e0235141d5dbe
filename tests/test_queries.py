"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from cohortlens.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return found


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, con, sf):
    df = queries.QUERIES[name](spark, sf)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    if name in queries.SQL:
        found = con.execute(queries.SQL[name])
        assert got == normal(found.fetchall(), [c[0] for c in found.description])
    else:
        assert got[1]
