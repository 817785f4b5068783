import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstone.llm import lm_score
from loamstone.llm.lm_score import Shape
from loamstone.llm.queries import op11_lm_score
from tests.llm.helpers import ascii_lower, docs, random_texts
from tests.measures import shuffled

#: So many bits that no probe goes wrong.
SURE = {"bits": 96, "hashes": 16}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))


def held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def brute(rows, shape):
    """Exact counts in dictionaries, quantised, one token after the other."""
    train = [split(t) for i, t in rows if not held_out(i)]
    counts, unigrams = Counter(), Counter()
    for w in train:
        laid = [None, *w, None]
        unigrams.update(laid[1:])
        for k in range(1, shape.order + 1):
            counts.update(tuple(laid[p - k + 1 : p + 1]) for p in range(max(1, k - 1), len(laid)))
    n, v = sum(unigrams.values()), len(unigrams)
    of_level, estimates = shape.estimates(), {0: 0.0}
    for c in set(counts.values()):
        estimates[c] = float(of_level[int(shape.levels(np.array([c]))[0])])
    estimate = lambda g: estimates[counts[g] if g in counts else 0]
    out = []
    for i, t in rows:
        laid = [None, *split(t), None]
        base = sum(math.log10((unigrams[w] + 0.1) / (n + 0.1 * (v + 1))) for w in laid[1:])
        score = 0.0
        for p in range(1, len(laid)):
            x = (estimate((laid[p],)) + 0.1) / (n + 0.1 * (v + 1))
            for k in range(2, min(shape.order, p + 1) + 1):
                h, g = estimate(tuple(laid[p - k + 1 : p])), estimate(tuple(laid[p - k + 1 : p + 1]))
                x = (min(g, h) + shape.mu * x) / (h + shape.mu)
            score += math.log10(x)
        out.append((i, len(laid) - 1, sum(unigrams[w] > 0 for w in laid[1:]), base, score))
    return out


def rows():
    out = list(enumerate(random_texts(90, 3)))
    out += [(90, None), (91, ""), (92, " \t\x0b "), (None, "abc Abc ABC"), (93, "É é abc"), (5, out[5][1]), (5, out[5][1])]
    return out + [(94, "x" * 300_000 + " b"), (95, "a b " * 20_000), (96, "never seen"), (97, "\x00 a　b"), (98, "word " * 3)]


def scored(spark, given, shape, **limits):
    frame = docs(spark, given)
    model = lm_score.train(frame.where(lm_score.trains(F.col("doc_id"))), shape, **limits)
    return model, sorted((tuple(r) for r in lm_score.score(frame, model).collect()), key=repr)


def agree(found, want):
    assert len(found) == len(want)
    for f, w in zip(found, sorted(want, key=repr), strict=True):
        assert f[:3] == w[:3] and f[3:] == pytest.approx(w[3:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, order):
    shape = Shape(order=order, **SURE)
    agree(scored(spark, rows(), shape)[1], brute(rows(), shape))


def test_many_segments_by_either_way(spark, monkeypatch):
    """Broadcast or shuffled, with most words beyond the broadcast head: the same results."""
    monkeypatch.setattr(lm_score, "HEAD", 7)
    monkeypatch.setattr(lm_score.head_words, "__defaults__", (7,))
    shape = Shape(order=2, **SURE)
    model, wide = scored(spark, rows(), shape, segment_tokens=5_000)
    assert model.segments > 10 and model.filter is not None and len(model.head.value[0]) <= 7
    model, far = scored(spark, rows(), shape, segment_tokens=5_000, filter_bytes=0)
    assert model.filter is None
    agree(wide, brute(rows(), shape))
    agree(far, wide)


def test_levels_of_the_production_filter(spark):
    """No level is too low; few are too high; few n-grams that are not there are found."""
    shape, r = Shape(), np.random.default_rng(5)
    hashes = r.integers(0, 2**63, 200_000).astype(np.uint64)
    counts = np.minimum(r.zipf(1.6, 100_000), 1_000_000)
    packed = [(int(s), h.tobytes(), n.astype("<i4").tobytes()) for s in range(4) for at in [lm_score.segment_of(hashes[:100_000], 4) == s] for h, n in [(hashes[:100_000][at], counts[at])]]
    frame = spark.createDataFrame([(s, bytearray(h), bytearray(n)) for s, h, n in packed], "segment int, hashes binary, counts binary")
    made = lm_score.Filter({x.segment: bytes(x.bits) for x in lm_score.build(frame, shape).collect()}, 4, shape)
    found, true = made.level(hashes), shape.levels(counts)
    assert (found[:100_000] >= true).all() and (found[:100_000] > true).mean() < 0.012 and (found[100_000:] > 0).mean() < 0.012
    assert 8 * len(made.data) <= true.sum() * shape.bits + 4 * 64


def test_estimates_stay_near_the_counts():
    shape, n = Shape(), np.arange(1, 100_000)
    assert (np.abs(shape.estimates()[shape.levels(n)] / n - 1) < 0.34).all() and shape.estimates()[0] == 0


def test_empty_tables(spark):
    assert scored(spark, [], Shape())[1] == []
    alone = [(i, t) for i, t in rows() if held_out(i)][:3]
    agree(scored(spark, alone, Shape())[1], brute(alone, Shape()))
    assert all(r[3] == r[4] == 0 for r in scored(spark, alone, Shape())[1])


def test_query_over_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    found = sorted(op11_lm_score(spark, path).collect())
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(brute(given, Shape()))
    tokens = sum(len(split(t)) + 1 for i, t in given if not held_out(i))
    assert len(found) == len(want)
    for f, w in zip(found, want, strict=True):
        assert f.doc_id == w[0] and f.held_out == held_out(f.doc_id) and (f.n_tokens, f.n_known, f.train_tokens) == (w[1], w[2], tokens)
        assert f.base_score == pytest.approx(w[3], rel=1e-9) and f.score == pytest.approx(w[4], rel=0.05)
    assert sum(f.score for f in found) == pytest.approx(sum(w[4] for w in want), rel=0.01)


def test_held_out_texts_are_likelier_than_by_their_words_alone(spark):
    found = op11_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[1] < found[0] < 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_learning_and_scoring_at_once(spark, monkeypatch, order):
    """Chunks of few texts and segments of few n-grams: as by dictionaries, and as with the model apart."""
    monkeypatch.setattr(lm_score, "DEALT_BYTES", 2_000)
    shape, frame = Shape(order=order, **SURE), docs(spark, rows())
    found, tokens = lm_score.fitted_scores(frame, lm_score.trains(F.col("doc_id")), shape, segment_tokens=5_000)
    agree(sorted((tuple(r) for r in found.collect()), key=repr), brute(rows(), shape))
    assert tokens == sum(len(split(t)) + 1 for i, t in rows() if not held_out(i))


def test_nothing_to_learn_from_or_to_score(spark):
    trains, alone = lm_score.trains(F.col("doc_id")), [(i, t) for i, t in rows() if held_out(i)][:3]
    assert lm_score.fitted_scores(docs(spark, []), trains)[0].collect() == []
    found = lm_score.fitted_scores(docs(spark, alone), trains)[0].collect()
    agree(sorted((tuple(r) for r in found), key=repr), brute(alone, Shape()))


def test_a_few_bytes_are_sent_for_each_distinct_gram_of_a_chunk(spark):
    """Not rows of n-grams, texts' numbers and segments, several times over: that was 12 bytes for each of the texts."""
    given = [(i, t) for i, t in enumerate(random_texts(4_000, 4, vocabulary=5_000, length=400))]
    frame = docs(spark, given).coalesce(2)
    sent = shuffled(spark, lambda: lm_score.fitted_scores(frame, lm_score.trains(F.col("doc_id")))[0])
    assert 0 < sent < 2 * sum(len(t) for _, t in given)


def test_a_model_beyond_its_broadcast_is_asked_once_a_chunk(spark):
    frame = docs(spark, [(i, t) for i, t in enumerate(random_texts(2_000, 5, vocabulary=5_000, length=400))]).coalesce(2)
    model = lm_score.train(frame.where(lm_score.trains(F.col("doc_id"))), filter_bytes=0)
    sent = shuffled(spark, lambda: lm_score.score(frame, model))
    assert 0 < sent < 4 * frame.agg(F.sum(F.length("text"))).first()[0]
