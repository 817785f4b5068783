"""Entities: decoded by the whole table, or only those that a query's SQL names."""

import html
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from loamstone.functions import text
from loamstone.plans import ORACLES, QUERIES

ODD = [
    None, "", "&", "&&", "plain", "a&amp;b", "&amp;lt;b&amp;gt;", "cut off &am", "cut off &amp", "&amp ;", "&notit;", "&#65;&#x42;&#99999999;&#0;", "&#", "&#x;", "&eacute;t&eacute",
    "&lt;b&gt;x&lt;/b&gt;", "&nosuch;", "&" + "a" * 40 + ";", "x&copyé;&copy;", "&middot;\U0001f600&quot;", "&NotEqualTilde;.", "a\n&\nb&\tc& d",
]


def test_the_whole_table_is_that_of_python(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", text.unescape_html(F.col("t")).alias("u"))
    assert [r.u for r in rows.orderBy("i").collect()] == [None if t is None else html.unescape(t) for t in ODD]


def test_texts_do_not_go_to_python(spark):
    sent = spark.createDataFrame([("x" * 1000 + "&amp;",)], "t string").select(text.unescape_html(F.col("t")).alias("u"))
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert "_decoded(transform(" in plan


def test_strip_html_agrees_with_its_sql_on_odd_entities(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{Path(tmp_path)}/pages.parquet/*.parquet'")
    assert {tuple(r) for r in QUERIES["strip_html"](spark, str(tmp_path)).collect()} == set(con.execute(ORACLES["strip_html"]).fetchall())
