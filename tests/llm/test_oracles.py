import os

import duckdb
import pytest

from loamstone.llm.oracles import ORACLES
from loamstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = QUERIES[name](spark, SF)
    made = db.execute(ORACLES[name])
    columns = [d[0] for d in made.description]
    assert sorted(columns) == sorted(found.columns)
    tidy = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    want = sorted(map(repr, map(tidy, made.fetchall())))
    assert sorted(repr(tidy(tuple(r))) for r in found.select(*columns).collect()) == want
