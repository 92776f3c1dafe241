"""Every query with a DuckDB counterpart gives the same rows; every other one runs."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from voxframe import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(tiny):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, tiny, name):
    df = QUERIES[name](spark, tiny)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        result = db.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, result.fetchall())


def test_every_statement_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_the_entry_does_without_the_llm_package():
    code = (
        "import sys; sys.modules['voxframe.llm'] = None; import __spark_entry__ as e; q = e.queries();"
        "assert q and not any(n.startswith(('p1_', 'p3_')) for n in q); assert set(e.oracle_sql()) <= set(q)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root})
