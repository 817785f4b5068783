"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from loamstone.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def tidy(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF)
    rows = sorted(repr(tidy(tuple(r))) for r in found.select(*sorted(found.columns)).collect())
    if name in ORACLES:
        made = db.execute(ORACLES[name])
        columns = [d[0] for d in made.description]
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        assert [columns[i] for i in order] == sorted(found.columns)
        assert rows == sorted(repr(tidy([r[i] for i in order])) for r in made.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 8
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
