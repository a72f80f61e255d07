from __future__ import annotations

import os

import duckdb
import pytest

from chorusmill.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    plain = lambda columns, rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for _, v in sorted(zip(columns, r, strict=True))) for r in rows), key=repr)
    assert plain(df.columns, df.collect()) == plain(want.columns, want.fetchall())
