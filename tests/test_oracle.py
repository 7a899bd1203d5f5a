"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from lodestrata.plans import registry


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.9g}"
        return str(v).replace("+00:00", "")

    return sorted(tuple(text(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    ours = registry.QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_a_docstring():
    assert all(f.__doc__ for f in registry.QUERIES.values())
