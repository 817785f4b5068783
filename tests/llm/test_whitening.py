import math
import random
from fractions import Fraction

import numpy as np
import pytest

from loamstone.llm import whitening
from loamstone.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<double>, x string, c int, y0 string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], "z", 1, "z") for i, v in rows], SCHEMA)


def brute(rows, components=4):
    """Exact sums, and numpy in double for the rest."""
    whole = lambda v: tuple(math.floor(256 * c) for c in v)
    fine = [(i, whole(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(x) for _, x in fine)
    fine = [(i, x) for i, x in fine if len(x) == dims]
    fit = sorted({x for _, x in fine})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in fine:
        c = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        for k in range(min(components, dims)):
            out[i, k + 1] = (n, deviation, abs(float(c @ vectors[:, k])) / math.sqrt(values[k]) if values[k] > 0 else None, values[k] / values.sum())
    return out


def random_rows(n, dims, seed=1):
    r = random.Random(seed)
    scale = [1 / (1 + k) for k in range(dims)]
    return [(i, [r.gauss(0.1, s) for s in scale]) for i in range(n)]


def awkward():
    rows = random_rows(60, 6)
    rows += [(60, None), (61, [None] * 6), (62, [1.0, NAN, 0, 0, 0, 0]), (63, [INF, 0.0, 0, 0, 0, 0]), (64, [-INF] * 6), (65, []), (66, [0.5] * 3)]
    return rows + [(67, rows[0][1]), (68, [c + 1e-9 for c in rows[1][1]]), (69, [0.0] * 6), (70, [-0.0] * 6)]


def test_against_brute_force(spark):
    found, want = whitening.whitened(table(spark, awkward())).collect(), brute(awkward())
    assert {(r.vec_id, r.component) for r in found} == set(want)
    for r in found:
        n, deviation, size, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, rel=1e-9, abs=1e-9) and r.explained == pytest.approx(share, rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
    assert len({r.identity_error for r in found}) == 1


def test_signs_are_those_of_one_component(spark):
    rows = random_rows(80, 5)
    found = whitening.whitened(table(spark, rows)).where("component = 1").collect()
    w = np.array([r.whitened for r in sorted(found, key=lambda r: r.vec_id)])
    assert abs(w.mean()) < 1e-9 and w.var() == pytest.approx(1)


def test_no_variance(spark):
    same = whitening.whitened(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, 0.0, None)}
    line = whitening.whitened(table(spark, [(i, [i / 4, i / 2, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line if r.whitened is None} == {2, 3} and all(r.identity_error < 1e-9 for r in line)


def test_large_entries_stay_exact(spark):
    """Longs would overflow: decimals take over, and a deviation of over 38 digits is null."""
    rows = [(i, [v, 1.0]) for i, v in enumerate([2.0**40, -(2.0**41), 3.0, 2.0**30])]
    found, want = whitening.whitened(table(spark, rows)).collect(), brute(rows)
    assert all(int(r.deviation) == want[r.vec_id, r.component][1] for r in found) and want[0, 1][1] > 2**63
    huge = whitening.whitened(table(spark, [(i, [v, 1.0]) for i, v in enumerate([1e300, -1e300, 3.0])])).collect()
    assert len(huge) == 6 and any(r.deviation is None for r in huge)


def test_empty_table(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).count() == 0


def test_many_dimensions_take_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS", 7)
    rows = random_rows(40, 6)
    found, want = whitening.whitened(table(spark, rows), components=2).collect(), brute(rows, 2)
    assert all(abs(r.whitened) == pytest.approx(want[r.vec_id, r.component][2], rel=1e-9) for r in found) and len(found) == 80


def test_query_over_the_whole_table(spark):
    found = op12_whitening(spark, "/root/testdata/sf0.001").toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want = brute(rows)
    assert len(found) == len(want) and dict(found.dtypes.astype(str))["deviation"] == "int64"
    for r in found.itertuples():
        n, deviation, size, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened) == pytest.approx(size, abs=1e-8) and r.explained == pytest.approx(share, rel=1e-9)
    assert found.identity_error.max() < 1e-9
