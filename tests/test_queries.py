"""Every query of the core against its SQL, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from foliant.plans import core, files, services

QUERIES, SQL = {**core.QUERIES, **files.QUERIES, **services.QUERIES}, {**core.SQL, **files.SQL, **services.SQL}


def _rows(d: pd.DataFrame) -> list[str]:
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        if d[c].dtype.kind in "if" or str(d[c].dtype) in ("Int64", "Int32"):
            d[c] = d[c].astype(float).round(6)
        d[c] = d[c].astype(object).where(d[c].notna(), None)
    return sorted(map(str, d.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert list(got.columns)
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)
