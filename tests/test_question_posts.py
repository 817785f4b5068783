"""All texts as questions, whatever their id."""

import duckdb

from loamstone.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_no_id_decides_which_texts_are_stripped(spark):
    rows = {tuple(r) for r in QUERIES["question_posts_all"](spark, SF).select("source", "text_sha256").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows == set(con.execute(ORACLES["question_posts_all"]).fetchall())
    assert {int(source.rsplit(":", 1)[1]) % 6 for source, _ in rows} == set(range(6))
