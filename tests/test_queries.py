"""Every query against its SQL twin in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from lernwerk.operators import registry
from lernwerk.sources.views import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        expected = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
    else:
        assert len(found) > 0


def test_every_query_is_named_once():
    names = [n for m in registry.MODULES for n in m.R.queries]
    assert len(names) == len(set(names))
