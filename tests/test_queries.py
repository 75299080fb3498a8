"""Every registered query of the survey against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from rowfield.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return (0, "") if value is None else (2, float(value) + 0.0) if not isinstance(value, str | bool) else (1, str(value))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    twin = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    at = [twin.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    want = sorted(tuple(plain(r[i]) for i in at) for r in twin.fetchall())
    assert got == want


def test_the_rest_imports_without_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['rowfield.llm'] = None; import __spark_entry__ as e; assert not [k for k in e.queries() if k.startswith('op')]; assert e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
