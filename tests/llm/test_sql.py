"""Queries of the subpackage against their SQL twins in DuckDB."""

import duckdb
import pytest

from framegauge.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df, want = queries.queries()[name](spark, sf_dir), duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
