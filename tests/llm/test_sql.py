"""Queries whose rows SQL can make, against DuckDB over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from lawloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([row[columns.index(c)] for c in sorted(columns)]) for row in result.fetchall())
    got = sorted(repr([row[c] for c in sorted(columns)]) for row in df.collect())
    assert got == want
