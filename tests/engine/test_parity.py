"""Each registered query with SQL against DuckDB, over the smallest tables."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import pytest

from tallyloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return str(list(x)) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    duck.execute(catalog.ORACLES[name])
    theirs = [d[0] for d in duck.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in duck.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_band_joins_have_an_equi_key(spark):
    plan = catalog.QUERIES["j4_search_visit_band"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
