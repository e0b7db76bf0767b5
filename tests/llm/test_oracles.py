"""Queries that have SQL against DuckDB."""

import duckdb
import pytest

from loomgrid.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    duck.execute(oracle_sql()[name])
    columns = [c[0] for c in duck.description]
    rows = duck.fetchall()
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert [columns[i] for i in order] == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*sorted(df.columns)).collect()))) == sorted(str(tuple(r[i] for i in order)) for r in rows)
