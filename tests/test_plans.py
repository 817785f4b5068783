"""Properties of physical plans that the engine relies on."""

import re

import pytest
from pyspark.sql import functions as F

from loamstone.operators import fts, joins, ranking
from loamstone.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(df):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*)>", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, SF))


def test_top_k_sorts_no_more_than_it_returns(spark):
    chunks = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    made = plan(ranking.top_k(chunks, [0.1] * 64, key="vec_id"))
    assert "TakeOrderedAndProject" in made and "Exchange" not in made


def test_dedup_limits_groups_before_the_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = plan(joins.first_by(docs.select("doc_id", "source"), ["source"], "doc_id"))
    assert made.count("WindowGroupLimit") == 2


def test_scans_read_what_is_asked(spark):
    assert columns_read(QUERIES["rollup_sources"](spark, SF)) == [{"source"}]
    assert columns_read(QUERIES["low_quality_hits"](spark, SF)) == [{"doc_id", "text", "source"}]
    for read in columns_read(QUERIES["anti_join_incremental"](spark, SF)):
        assert read in ({"doc_id", "source"}, {"label"})


def test_filters_reach_the_scan(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fts.build_index(docs, str(tmp_path))
    found = spark.read.parquet(f"{tmp_path}/postings").where("term = 'the'")
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,the)]" in plan(found)
    questions = spark.createDataFrame([(1, "the")], "qid int, term string")
    stored = fts.bm25(spark.read.parquet(f"{tmp_path}/postings"), spark.read.parquet(f"{tmp_path}/docstats"), questions, 5)
    fresh = fts.bm25(fts.postings(docs), fts.doc_stats(docs), questions, 5)
    key = lambda df: [(r.doc_id, round(r.score, 9)) for r in df.orderBy("rank").collect()]
    assert key(stored) == key(fresh)


def test_counts_stay_in_the_jvm(spark):
    for name in ("audit_counts", "bm25_topk", "chunk_stats", "boost_join", "context_budget", "intent_gate"):
        assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, SF))), name
