import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamstone.llm import toxicity
from tests.llm.helpers import docs, random_texts

BAD = ("grompf", "grompfling", "grompfish", "zutwat", "zutwaty")


def corpus(n=900, seed=1):
    r = random.Random(seed)
    out = []
    for i, t in enumerate(random_texts(n, seed, vocabulary=400, length=80)):
        toxic = int(i % 4 == 0)
        words = t.split(" ")
        for _ in range(3 * toxic):
            words.insert(r.randint(0, len(words)), r.choice(BAD))
        out.append((i, " ".join(words), toxic))
    return out


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    rows = np.array([0, 0, 5, 6, 14])
    scores, moves = r.normal(size=14), np.exp(r.normal(size=4))
    got = toxicity.marginals(scores, rows, moves)
    table = moves.reshape(2, 2)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        n, total, ones = b - a, 0.0, np.zeros(b - a)
        for path in np.ndindex(*(2,) * n) if n else ():
            w = np.exp(sum(scores[a + k] for k in range(n) if path[k])) * np.prod([table[x, y] for x, y in zip(path, path[1:], strict=False)])
            total += w
            ones += w * np.array(path)
        if n:
            assert np.allclose(got[a:b], ones / total)


def uncut(scores, moves):
    """Marginals of one chain by a plain recursion over all its words."""
    table, own = moves.reshape(2, 2), np.exp(np.column_stack([np.zeros(len(scores)), scores]))
    ahead, behind = own.copy(), np.ones((len(scores), 2))
    for t in range(1, len(scores)):
        ahead[t] = own[t] * (ahead[t - 1] @ table)
        ahead[t] /= ahead[t].sum()
    for t in range(len(scores) - 2, -1, -1):
        behind[t] = table @ (own[t + 1] * behind[t + 1])
        behind[t] /= behind[t].sum()
    both = ahead * behind
    return both[:, 1] / both.sum(axis=1)


def test_a_document_is_one_chain_wherever_its_pieces_end():
    r = np.random.default_rng(1)
    moves = np.exp(r.normal(size=4))
    sizes = [0, 1, 511, 512, 513, 1024, 1025, 0, 5000, 3]
    rows, scores = np.concatenate([[0], np.cumsum(sizes)]), r.normal(scale=3, size=sum(sizes))
    got = toxicity.marginals(scores, rows, moves)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        assert np.allclose(got[a:b], uncut(scores[a:b], moves), rtol=1e-9, atol=1e-12)
    want = None
    for at in range(3, 1100):  # a span has the same marginals at every place
        scores = np.full(1200, -4.0)
        scores[at : at + 3] = 5.0
        around = toxicity.marginals(scores, np.array([0, 1200]), moves)[at - 3 : at + 6]
        inner = around if 100 < at < 1000 else None
        want = inner if want is None else want
        if inner is not None:
            assert np.allclose(inner, want, rtol=1e-9)
        if at % 97 == 0:
            assert np.allclose(around, uncut(scores, moves)[at - 3 : at + 6], rtol=1e-9)


def test_no_feature_hides_another():
    known = np.unique(np.concatenate([np.arange(5, dtype=np.uint64) + np.uint64(7 << 50), np.random.default_rng(2).integers(0, 2**63, 3000, dtype=np.uint64)]))
    weights = np.arange(1, len(known) + 1, dtype=np.float32)
    table = toxicity.Table(known, weights)
    assert (table.weight(known) == weights).all() and (table.weight(known + np.uint64(1000)) == 0).all()
    assert (toxicity.Table(known[:0], weights[:0]).weight(known) == 0).all()


def test_held_out_accuracy(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (3, None, "x"), (5, 0, "x")], "doc_id long, toxic int, text string")
    extra = [(5000, None), (5001, ""), (5002, "..."), (None, "grompf zutwat"), (5003, "calm " * 100_000), (5004, "calm " * 50_000 + "Grompf ZUTWAT grompfling"), (5004, "calm")]
    table = docs(spark, [(i, t) for i, t, _ in rows] + extra)
    model = toxicity.train(table, labels)
    tagged = toxicity.tag(table, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(tagged) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    tested = [r for r in tagged if r.held and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in tested) and len(tested) > 100
    assert sum(r.predicted != truth[r.doc_id] for r in tested) <= 0.03 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in tagged)
    by = {}
    for r in tagged:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].predicted == 1 and by[5003][0].predicted == 0 and by[5000][0].predicted == 0
    assert sorted(r.predicted for r in by[5004]) == [0, 1]
    text = {i: t for i, t, _ in rows}
    for r in tagged:
        if r.doc_id in text and r.held and truth[r.doc_id] and r.predicted:
            assert any(text[r.doc_id][s.start : s.end].split(" ")[0] in BAD for s in r.spans)
    kept = toxicity.without_toxic(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r.predicted == 0 for r in tagged)


def test_all_texts_are_learned_from(spark):
    """Long texts, repeated ids and null texts enter the fit; the sample bounds ids, one text of each."""
    rows = [(i, " ".join(random_texts(60, i, vocabulary=400, length=80)) + t[len(t) // 2 :]) for i, t, _ in corpus(160)]
    assert min(len(t) for _, t in rows) > 5000
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus(160)], "doc_id long, toxic int")
    rows = [(i, t + " grompf zutwat " * (i % 4 == 0) + t[:99] + " zutwaty grompfish" * (i % 4 == 0)) for i, t in rows]
    model = toxicity.train(docs(spark, rows + [(7, "zzz grompf")] * 50 + [(6, None)]), labels)
    asked = [(900, rows[0][1]), (901, rows[1][1])]
    got = {r.doc_id: r.predicted for r in toxicity.tag(docs(spark, asked), model).collect()}
    assert got == {900: 1, 901: 0}


def test_without_labels(spark):
    table = docs(spark, [(1, "a b"), (2, None)])
    for rows in ([], [(1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert [r.predicted for r in toxicity.tag(table, toxicity.train(table, labels)).collect()] == [0, 0]
    assert toxicity.tag(table.limit(0), toxicity.fit(pa.array([], pa.string()), np.zeros(0))).count() == 0
