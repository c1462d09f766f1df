"""Every query of the catalogue against its SQL, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from chalkline.plans import catalogue, catalogue_rules  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    if name not in catalogue.SQL:
        assert rows
        return
    expected = duck.sql(catalogue.SQL[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    assert rows == sorted(([plain(r[i]) for i in places] for r in expected.fetchall()), key=repr)
