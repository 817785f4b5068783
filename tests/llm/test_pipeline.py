import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from loamstone.llm import toxicity
from loamstone.llm.common import materialise
from tests.llm.helpers import SPACE, ascii_lower
from tests.llm.test_decontaminate import brute as hit_brute
from tests.llm.test_mix import brute_targets
from tests.llm.test_near_dup import brute as near_brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_in_order_and_their_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "decontaminate", "mix"]
    for df in stages[:-1]:
        assert df.columns == COLUMNS
    assert stages[-1].columns[:5] == COLUMNS


def test_each_stage_decides_about_all_that_came(spark, stages):
    counts = [spark.read.parquet(f"{SF}/documents.parquet").count(), *(d.count() for d in stages)]
    assert counts[0] > counts[1] == counts[2] > counts[3] >= counts[4] >= counts[5] > 0
    assert stages[1].where(F.col("n_chars") != F.length("text")).isEmpty()
    mixed = stages[-1].agg(F.sum("taken").alias("t")).first().t
    words = stages[3].select(F.size(F.filter(F.split("text", "[ \t\n\x0b\x0c\r]+"), lambda w: w != "")).alias("n")).agg(F.sum("n")).first()[0]
    assert abs(mixed - words) <= 20


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, hits string"
    rows = [(1, None, None, None, None, 1, "h"), (2, "", "en", "a", 0, 1, None), (None, "some words", None, None, 10, 1, "h"), (3, "some words", "en", None, 10, 1, "h"), (3, "some words", "en", None, 10, 1, "h"), (4, "w " * 50_000, "en", "b", 100_000, 1, "h")]
    for name, kind in (("labels", "doc_id long, toxic int, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == (4 if data else 0)


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and "pipeline" not in __spark_entry__.oracle_sql()
    assert os.path.exists(SF)


def plain_lines(rows, min_docs=5, min_chars=40):
    key = lambda line: ascii_lower(line.strip(SPACE))
    where = {}
    for i, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= min_chars:
                where.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    return [(i, "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i)) for i, t in rows]


def plain_mix(rows, source):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows}
    total = {}
    for i in size:
        total[source[i]] = total.get(source[i], 0) + size[i]
    taken = dict.fromkeys(size, 0)
    for s, target in brute_targets(total).items():
        stream = []  # the document of each word of the source, in order
        for i in sorted((i for i in size if source[i] == s), key=lambda i: hashlib.md5(f"0|{i}".encode()).hexdigest()):
            stream += [i] * size[i]
        left, epoch = round(target), 0
        while left > 0:
            blocks = range(-(-len(stream) // 4096))
            for b in sorted(blocks, key=lambda b: hashlib.md5(f"0|{s or ''}|{epoch}|{b}".encode()).hexdigest()):
                block = stream[b * 4096 : b * 4096 + 4096][:left]
                left -= len(block)
                for i in block:
                    taken[i] += 1
            epoch += 1
    return {i: n for i, n in taken.items() if n}


def test_whole_pipeline_against_brute_force(spark):
    """All stages in plain Python, but for the model's verdicts, which test_toxicity holds against enumeration."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.tag(docs, model).where("predicted = 1").collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = plain_lines([(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id not in toxic])
    kept = {i for i, _, _, k in near_brute(rows, 5) if k}
    rows = [(i, t) for i, t in rows if i in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, _, _ in hit_brute(rows, items)}
    assert toxic and hit and len(kept) < len(source) - len(toxic)
    rows = [(i, t) for i, t in rows if i not in hit]
    text, want = dict(rows), plain_mix(rows, source)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.taken for r in got} == want
    assert all((r.text or "") == text[r.doc_id] for r in got)
