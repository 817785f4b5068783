import math
import random

from loamstone.llm import vector_join
from tests.llm.helpers import smallest_reachable


def brute(rows, cosine=0.9):
    def able(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(k, i, v) for k, (i, v) in enumerate(rows) if able(i, v)]
    n, links = {}, []
    for x, (k, i, v) in enumerate(good):
        for m, j, w in good[:x]:
            if len(v) == len(w):
                c = math.fsum(a * b for a, b in zip(v, w)) / math.sqrt(math.fsum(a * a for a in v) * math.fsum(b * b for b in w))
                if c >= cosine:
                    n[k], n[m] = n.get(k, 0) + 1, n.get(m, 0) + 1
                    links.append((i, j))
    top = smallest_reachable({i for i, _ in rows if i is not None}, links)
    return sorted(((i, n.get(k, 0), top.get(i), i is None or top[i] == i) for k, (i, v) in enumerate(rows)), key=repr)


def vectors(n, dim, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        c = centres[i % 6]
        s = r.choice([0.02, 0.2, 0.6, 2.0])
        out.append((i * 13 % 1009, [round(x + r.gauss(0, s), 2) for x in c]))
    return out


def check(spark, rows, **params):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, links int")
    found = vector_join.cosine_join(df, **params)
    assert sorted(map(tuple, found.collect()), key=repr) == brute([(i, None if v is None else [None if x is None else f32(x) for x in v]) for i, v in rows])


def check_doubles(spark, rows, **params):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vector_join.cosine_join(df, **params).collect()), key=repr) == brute(rows)


def test_ties_at_the_threshold_link(spark):
    """Integer vectors whose cosine is 9/10 exactly."""
    first = ([7, 7, 7, 7], [5, 1, 5, 7])
    r = random.Random(9)
    ties = []
    while len(ties) < 30:
        a, b = ([r.randint(-9, 9) for _ in range(4)] for _ in range(2))
        dot, aa, bb = (sum(x * y for x, y in zip(p, q)) for p, q in ((a, b), (a, a), (b, b)))
        if dot > 0 and 100 * dot * dot == 81 * aa * bb:
            ties.append((a, b))
    for kind in ("float", "double"):
        rows = [(2 * i + k, [float(x) for x in v] + [0.0] * (i % 3)) for i, pair in enumerate([first, *ties]) for k, v in enumerate(pair)]
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = {r.vec_id: r for r in vector_join.cosine_join(df).collect()}
        assert sorted(map(tuple, got.values()), key=repr) == brute(rows)
        assert all(got[i].n_links > 0 and got[i ^ 1].component_id == got[i].component_id for i in got)


def test_doubles_stay_doubles(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e300, 0.0]), (3, [1e-320, 0.0]), (4, [0.0, 1e308]), (5, [1.0, 1e-9]), (6, [1.0, 1.0000000001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.cosine_join(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


def test_large_cells_are_split_again_and_dense_ones_compared_with_nobody(spark, monkeypatch):
    r = random.Random(11)
    rows = [(i, [1 + r.gauss(0, 0.01), r.gauss(0, 0.01), r.gauss(0, 0.01)]) for i in range(150)]  # one dense cell
    rows += [(200 + i, [r.gauss(0, 1), 5 + r.gauss(0, 1), r.gauss(0, 1)]) for i in range(150)]
    monkeypatch.setattr(vector_join, "MAX_PIVOTS", 4)
    compared = []
    real = vector_join.materialise

    def watched(df, label, **options):
        out = real(df, label, **options)
        compared.append((label, out.where("node < 200").count() if label == "found" else 0))
        return out

    monkeypatch.setattr(vector_join, "materialise", watched)
    check_doubles(spark, rows, block=8, least_cells=2)
    assert sum(label == "homes" for label, _ in compared) > 1
    assert dict(compared)["found"] == 0  # all 150 * 149 links of the dense cell without a block
    monkeypatch.setattr(vector_join, "PIVOT_BYTES", 0)
    check_doubles(spark, rows, block=8, least_cells=2)


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0] if math.isfinite(x) else x


def test_against_brute_force(spark):
    check(spark, vectors(200, 8, 1))
    check(spark, vectors(200, 3, 2), block=16, least_cells=4)


def test_awkward_vectors(spark):
    rows = vectors(30, 4, 3)
    rows += [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [1.0, None, 0.0, 0.0]), (2004, [float("nan"), 1.0, 1.0, 1.0]), (2005, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (2006, [1.0, 2.0, 3.0, 4.0]), (2007, [1.0, 2.0, 3.0, 4.0]), (2007, [1.0, 2.0, 3.0, 4.0]), (2008, [2.0, 4.0, 6.0, 8.0])]
    rows += [(2009, [1.0, 2.0]), (2010, [2.0, 4.0]), (2011, [-0.0, 1.0, 0.0, 0.0]), (2012, [0.0, 1.0, 0.0, 0.0]), (2013, [1e-30, 0.0, 0.0, 0.0]), (2014, [1e30, 0.0, 0.0, 0.0])]
    rows += [(2015, [5.0, 1.0, 0.0, 9.0]), (2015, [-9.0, 1.0, 7.0, 0.0])]
    check(spark, rows)


def test_one_id_with_more_vectors_than_a_block(spark):
    """Its rows fill several blocks, some of which get no row; no link counts twice."""
    r = random.Random(5)
    rows = [(7, [1.0, r.uniform(0, 0.5), r.uniform(0, 0.5)]) for _ in range(40)] + [(8, [1.0, 0.2, 0.1]), (9, [0.1, 1.0, 0.0])]
    check(spark, rows, block=4, least_cells=1)
    check(spark, rows, block=4, least_cells=4)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_join.cosine_join(df).count() == 0
