"""Every query with SQL equals it, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, str(DATA))
    order = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    found = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    at = [columns.index(c) for c in order]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(columns) == order
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 32 and df.count() > 0


def test_sample_is_stable(spark):
    q = entry.queries()["q_reservoir_sample"]
    assert q(spark, str(DATA)).collect() == q(spark, str(DATA)).collect()
