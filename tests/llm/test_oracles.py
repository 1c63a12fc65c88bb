"""Queries with SQL agree with DuckDB on the smallest driver tables."""

import duckdb
import pytest

from conftest import SF001
from tractlens.llm import queries

TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF001)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    cols = rel.columns
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == sorted(
        queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in names
