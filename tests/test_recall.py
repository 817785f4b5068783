"""Quantised top-k against exact top-k, at every size."""

import random

import pytest

from loamstone.operators import ranking
from loamstone.plans import QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_quantised_batch_loses_nothing(spark, sf):
    found = QUERIES["binary_quantised_topk_batch"](spark, f"/root/testdata/{sf}").collect()
    n = {r.qid for r in found}
    assert len(found) == 20 * len(n)
    exact = QUERIES["vector_topk_batch"](spark, f"/root/testdata/{sf}").collect()
    assert n == {r.qid for r in exact}
    assert {tuple(r) for r in exact} == {tuple(r) for r in found if r["rank"] <= 5}


def test_sign_bits_leave_out_what_is_far(spark):
    """Clusters of opposite signs, where the bound excludes rows; ties, repeated rows, zeros and fewer rows than k."""
    r = random.Random(3)
    centres = [[r.choice((-1.0, 1.0)) for _ in range(16)] for _ in range(8)]
    rows = [(i, [x + r.choice((0.0, 0.1, -0.1, 1.0)) for x in centres[i % 8]]) for i in range(3000)]
    rows += [(3000 + i, rows[i][1]) for i in range(50)] + [(3100, [0.0] * 16), (3101, None)]
    chunks = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    questions = spark.createDataFrame([(i, v) for i, v in rows[::97] if v], "qid long, vector array<double>")
    key = lambda df: sorted(tuple(x) for x in df.select("qid", "id", "rank", "_distance").collect())
    for k in (1, 20, 4000):
        some = questions if k < 4000 else questions.limit(2)
        assert key(ranking.top_k_join(some, chunks, k, quantised=True)) == key(ranking.top_k_join(some, chunks, k))
