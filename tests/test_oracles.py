"""Every registered core query against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from tessera.plans.catalog import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 8)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert rows
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
