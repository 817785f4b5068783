import random

import numpy as np

from loamstone.llm import near_dup, textvec
from loamstone.llm.graph import components
from tests.llm.helpers import docs, edited, random_texts, shingles, smallest_reachable


def brute(rows, n):
    sets = [(i, shingles(t, n)) for i, t in rows]
    links = []
    for x in range(len(sets)):
        for y in range(x):
            (a, s), (b, t) = sets[x], sets[y]
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                links.append((a, b))
    top = smallest_reachable({i for i, _ in rows if i is not None}, links)
    return sorted(((i, len(s), top.get(i), i is None or top[i] == i) for i, s in sets), key=repr)


def check(spark, rows, n, **params):
    found = near_dup.near_duplicates(docs(spark, rows), words=n, **params)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, n)


def texts():
    r = random.Random(3)
    out = random_texts(60, 1)
    out += [edited(t, r, 0.03 * (k % 4)) for k in range(1, 5) for t in out[:40]]
    return [(i * 7 % 997, t) for i, t in enumerate(out)]


def test_against_brute_force(spark):
    for n in (2, 5):
        check(spark, texts(), n)


def test_awkward_rows(spark):
    long = " ".join(f"w{i % 5000}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (None, None), (7, "é one"), (8, "É one")]
    rows += [(9, long), (10, long + " tail"), (5, "one"), (11, "a b c d"), (11, "e f g h"), (12, "a b c d"), (13, "e f g h")]
    check(spark, rows, 2)
    check(spark, rows, 5)
    check(spark, rows, 2, broadcast_rows=0)


def test_chain_of_links_outside_the_star(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[12 * k : 12 * k + 120])) for k in range(20)]
    check(spark, rows, 2)


def test_group_of_copies_in_small_blocks(spark):
    r = random.Random(5)
    base = " ".join(f"w{i}" for i in range(80))
    check(spark, [(i, edited(base, r, 0.06)) for i in range(120)], 2, block=16)


def test_empty_table(spark):
    assert near_dup.near_duplicates(docs(spark, []), words=2).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(4, "a b c d e f"), (2, "A b c d e f"), (9, "other words of no kin at all"), (None, "a b c d e f")]
    kept = near_dup.without_near_duplicates(docs(spark, rows), words=5)
    assert sorted(kept.select("doc_id").toPandas()["doc_id"].fillna(-1)) == [-1, 2, 9]
    assert kept.columns == docs(spark, []).columns


def test_densified_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    for size in (3, 20, 2000):
        agree = []
        for _ in range(60):
            pool = r.integers(0, 2**63, size * 2, dtype=np.uint64)
            a, b = np.sort(pool[: size + size // 2]), np.sort(pool[size // 2 :][: size + size // 2])
            sig = near_dup.signatures([a, b], 252)
            agree.append((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree)) < 0.06


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(3, 500), (500, 7), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for link in links[:-1] for n in link}
    assert found == smallest_reachable(nodes, links[:-1])


def thue_morse(letters, n=1024):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_under_polynomial_hashes(spark):
    """Complementary words of this kind hash alike modulo 2^64 for every byte table and odd base."""
    check(spark, [(1, thue_morse("ab")), (2, thue_morse("ba")), (3, thue_morse("ab", 128) + " x"), (4, thue_morse("ba", 128) + " x")], 2)


def test_links_are_confirmed_by_words(monkeypatch):
    """Where all words hash alike, words are still told apart."""
    texts = [b"Alpha beta gamma", b"alpha  BETA gamma", b"alpha beta delta", b"alpha", b"", b"x" * 300 + b" y", b"x" * 301 + b" y"]
    want = [shingles(t.decode(), 2) for t in texts]
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(textvec, "span_hashes", lambda data, starts, stops, seed=0: np.full(len(starts), 7, dtype=np.uint64))
        got = textvec.exact_sets(texts, 2)
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_exact_sets_of_five_words():
    r = random.Random(2)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(40)]
    got, want = textvec.exact_sets([t.encode() for t in texts], 5), [shingles(t, 5) for t in texts]
    for i in range(40):
        for j in range(40):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_forest_connects_what_the_edges_do():
    r = random.Random(4)
    for n in (1, 5, 40):
        edges = [(r.randint(0, n), r.randint(0, n) + 100) for _ in range(3 * n)]
        chosen = near_dup._forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
        nodes = {x for e in edges for x in e}
        assert smallest_reachable(nodes, [edges[i] for i in chosen]) == smallest_reachable(nodes, edges)
        assert len(chosen) < len(nodes)
    assert len(near_dup._forest(np.zeros(0, int), np.zeros(0, int))) == 0


def test_blocks_hold_few_shingles(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, edited(" ".join(base[: 50 + i % 40]), r, 0.05)) for i in range(90)]
    check(spark, rows, 2, block=8, block_shingles=300)


def test_words_that_are_made_to_collide(spark):
    """Two words with one hash under the key 0: sizes stay exact and no link is lost."""
    w, v = "7;9n1|d45aaa!da0", "[x!9m|60@moi_@.]"
    a = " ".join(f"{w} c{i} {v} c{i}" for i in range(10))
    rows = [(1, f"{w} z {v} z"), (2, a), (3, a + " " + " ".join(f"new{i}" for i in range(8)))]
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs(spark, rows), words=2).collect()}
    sets = {i: shingles(t, 2) for i, t in rows}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert 100 * len(sets[2] & sets[3]) >= 80 * len(sets[2] | sets[3]) and got[3].component_id == 2
