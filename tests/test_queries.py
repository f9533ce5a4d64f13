"""Every registered query of the register, extraction and streaming operators."""

import datetime
import math

import pytest

import __spark_entry__
from assetlens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, sf_dir, db, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    told = db.sql(catalog.SQL[name])
    cols = sorted(found.columns)
    assert cols == sorted(told.columns)
    places = [told.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in places) for r in told.fetchall())
    assert sorted(tuple(map(plain, r)) for r in found.select(*cols).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
