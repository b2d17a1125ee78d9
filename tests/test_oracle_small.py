"""Registered queries against their DuckDB twins on the smallest tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from thinkframe.plans.catalog import QUERIES

NAMES = sorted(QUERIES)


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_SMALL}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    s = _digest(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    d = _digest([x[0] for x in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(x[0] for x in cur.description)
    assert hashlib.md5("\n".join(s).encode()).hexdigest() == hashlib.md5("\n".join(d).encode()).hexdigest()


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["id", "task", "answer"]


def test_oracle_imports_nothing_of_the_engine():
    import inspect

    from thinkframe import oracle

    assert "from thinkframe" not in inspect.getsource(oracle) and "import thinkframe" not in inspect.getsource(oracle)
