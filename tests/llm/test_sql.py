"""Queries of this subpackage against their SQL."""

import duckdb
import pytest

from rowfield.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, twin = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(twin.columns)
    at = [twin.columns.index(c) for c in names]
    rows = sorted(str([r[c] for c in names]) for r in df.collect())
    assert rows == sorted(str([r[i] for i in at]) for r in twin.fetchall()) and rows
