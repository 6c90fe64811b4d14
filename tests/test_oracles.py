"""Every registered league query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from touchline.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(float(v))
    return repr(round(float(v), 6)) if hasattr(v, "is_integer") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    a = sorted(tuple(norm(row[c]) for c in columns) for row in got.collect())
    at = [want.columns.index(c) for c in columns]
    b = sorted(tuple(norm(row[i]) for i in at) for row in want.fetchall())
    assert a == b
