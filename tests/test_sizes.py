"""What bounds the memory of Python and the work of a task, seen in plans."""

import numpy as np
from pyspark.sql import functions as F

from loamstone.operators import audit, chunking, embed, fts, joins, predicates
from loamstone.plans import files


def calls(df) -> int:
    """How many operators of the plan send rows to a Python function of values."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_findings_are_found_once(spark):
    answers = spark.createDataFrame([(1, "eval (x)"), (2, "fine"), (3, None), (4, "```py\nexec(a)\n``` and eval(b)"), (5, "``` eval(c)")] * 50, "doc_id int, text string")
    found = audit.audited(answers).where("size(findings) > 0").select("doc_id", audit.report(F.col("findings")).alias("r"))
    assert calls(found) == 1
    assert sorted({(r.doc_id, r.r.split(": ")[0]) for r in found.collect()}) == [(1, "- [CRITICAL] eval runs any code"), (4, "- [CRITICAL] exec runs any code"), (5, "- [CRITICAL] eval runs any code")]
    assert found.count() == 150


def test_chunks_are_cut_in_slices(spark):
    texts = [(i, ("word " * 700 + str(i)) if i % 7 else None, f"s{i}") for i in range(3 * chunking.SLICE + 1)]
    made = chunking.recursive_chunks(spark.createDataFrame(texts, "i int, text string, s string").coalesce(1))
    assert calls(made) == 0
    want = [(i, s, n, c) for i, t, s in texts for n, c in enumerate(chunking.split_recursively(t, 1000, 200) if t else [])]
    assert sorted(map(tuple, made.collect())) == want


def test_texts_are_embedded_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 3 else None) for i in range(40)], "i int, text string").coalesce(1)
    made = embed.with_vectors(embed.embedded(docs, lambda: embed.hashing_model(8), batch=7))
    assert calls(made) == 1
    model = embed.hashing_model(8)
    assert all(np.allclose(r.vector, model([r.text or ""])[0]) for r in made.collect()) and made.count() == 40


def test_entities_of_posts_are_decoded_once(spark):
    posts = spark.createDataFrame([("1", "1", "5", "t", "a &amp; b " * 30, "<x>")], "_Id string, _PostTypeId string, _Score string, _Title string, _Body string, _Tags string")
    made = predicates.question_posts(posts, F.lit("x"))
    assert calls(made) == 1
    assert made.first().text.endswith("a & b")


def test_short_rows_are_dealt_by_their_number(spark):
    assert files._dealt(spark.range(0, 20_001, 1, 1)).rdd.getNumPartitions() == 5


def test_words_of_an_index_are_not_shuffled(spark):
    rows = [(1, "b a B"), (2, None), (3, ""), (1, "c b a"), (1, "a"), (None, "z Z"), (5, "the the end")]
    made = fts.postings(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    want = [("a", 1, 1, 1), ("a", 1, 3, 2), ("b", 1, 3, 3), ("c", 1, 3, 1), ("end", 5, 3, 1), ("the", 5, 3, 2), ("z", None, 2, 2)]
    assert sorted(made.collect()) == want and made.columns == ["term", "doc_id", "len", "tf"]


def test_a_search_reads_its_terms(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} w{i % 3} common") for i in range(50)], "doc_id long, text string")
    fts.build_index(docs, str(tmp_path))
    asked = spark.createDataFrame([(1, "w1"), (1, "common"), (2, "w2"), (2, None)], "qid int, term string")
    search = lambda: fts.bm25(spark.read.parquet(f"{tmp_path}/postings"), spark.read.parquet(f"{tmp_path}/docstats"), asked, 4)
    found = search()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("In(term, [") == plan.count("ReadSchema: struct<term") == 2
    monkeypatch.setattr(joins, "FEW_VALUES", 1)
    many = search()
    assert "In(term, [" not in many._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    assert key(found) == key(many) and len(key(found)) == 8
