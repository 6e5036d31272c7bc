"""Every query beside its SQL, on the smallest tables."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(set(entry_module.oracle_sql()))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    return v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, sf, name):
    got = entry_module.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(want.columns) == columns
    key = lambda r: str(r)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    theirs = sorted((tuple(plain(v) for v in r) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=key)
    assert ours == theirs


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns[0] == "listing_id" and rows.count() > 0
