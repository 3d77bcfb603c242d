"""Every registered telemetry query against its DuckDB SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from fleetgauge.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "None" if isinstance(v, float) and math.isnan(v) else repr(float(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*order).collect())
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
