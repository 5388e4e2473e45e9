"""Every registered query of the library's own operators against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from stratalens.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLES:
        return
    want = tables.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
