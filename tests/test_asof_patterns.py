"""As-of joins and automata against loops."""

import random
import re

import pytest

from loamstone.operators import joins, predicates
from loamstone.operators.asof import as_of
from loamstone.operators.patterns import first_matches


def logs(seed, n, keys, span):
    r = random.Random(seed)
    probes = [(r.choice(keys), r.choice([None, *range(span)]) if r.random() < 0.1 else r.randint(0, span)) for _ in range(n)]
    entries = [(r.choice(keys), r.randint(0, span), r.choice([None, "a", "b", "c"])) for _ in range(n // 2)]
    return probes, entries


@pytest.mark.parametrize(("slices", "span"), [(1, 50), (7, 50), (64, 3), (256, 10_000)])
def test_as_of_against_a_loop(spark, slices, span):
    probes, entries = logs(slices, 400, ["hot", "hot", "hot", "x", "y", None], span)
    found = as_of(spark.createDataFrame(probes, "key string, t long"), spark.createDataFrame(entries, "key string, t long, value string"), slices)
    want = {}
    for k, t in probes:
        if k is not None and t is not None:
            before = [(u, v is not None, v or "") for j, u, v in entries if j == k and u <= t]
            want[k, t] = (max(before)[0], max(before)[2] or None) if before else None
    rows = found.collect()
    assert {(r.key, r.t): r.found and (r.found.t, r.found.value) for r in rows} == want and len(rows) == len(want)


def test_a_text_that_all_ask_stays_linear(spark):
    """No join of the logs themselves: a hot text gives as many rows as it has, dealt over slices of time."""
    n = 30_000
    queries = spark.range(n).selectExpr("id AS qid", "'hot' AS query", "timestamp_micros(id * 10) AS ts")
    entries = spark.range(n).selectExpr("'hot' AS query", "CAST(id AS STRING) AS result", "timestamp_micros(id * 10) AS created")
    found = joins.exact_cached(queries, entries, 1)
    assert found.where("CAST(result AS LONG) = qid").count() == n == found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    by = {tuple(re.findall(r"(\w+)#", keys)) for keys in re.findall(r"Join \[([^\]]*)\]", plan)}
    assert by and all(keys[-1] in ("t", "slice") for keys in by) and "NestedLoop" not in plan
    groups = as_of(queries.selectExpr("query AS key", "qid * 10 AS t"), entries.selectExpr("query AS key", "0L AS t", "result AS value"))
    assert groups.count() == n


def test_exact_cache_edges(spark):
    ask = lambda *rows: spark.createDataFrame(rows, "qid long, query string, t long").selectExpr("qid", "query", "timestamp_micros(t) AS ts")
    put = lambda *rows: spark.createDataFrame(rows, "query string, result string, t long").selectExpr("query", "result", "timestamp_micros(t) AS created")
    queries = ask((1, "a", 5), (2, "a", 4), (3, "b", 9), (4, None, 9), (5, "a", 2_000_005), (6, "a", 2_000_006), (7, "a", None), (8, "a", 5))
    found = joins.exact_cached(queries, put(("a", "old", 1), ("a", "x", 5), ("a", "y", 5), (None, "n", 1), ("a", "none", None)), 2)
    assert sorted(map(tuple, found.collect())) == [(1, "y"), (2, "old"), (5, "y"), (8, "y")]
    assert joins.exact_cached(queries, put(), 2).count() == joins.exact_cached(ask(), put(("a", "x", 1)), 2).count() == 0


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_first_matches_against_a_loop(spark, part_bytes):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    patterns = [(word(r.randint(1, 6)), r.randint(0, 99)) for _ in range(80)] + [(None, 0), ("x", None), ("Upper", 0), ("日本", 1)]
    texts = list({word(r.randint(0, 25)) for _ in range(200)}) + ["", "ABÉ" * 3, "UPPER", "x日本y", None]
    found = first_matches(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(patterns, "pattern string, ord int"), part_bytes)
    want = {}
    for t in filter(lambda t: t is not None, texts):
        hits = [o for p, o in patterns if p is not None and o is not None and p in t.lower()]
        if hits:
            want[t] = min(hits)
    assert {x.text: x.ord for x in found.collect()} == want
    everything = first_matches(spark.createDataFrame([("q",), ("",)], "text string"), spark.createDataFrame([("", 4), ("q", 2)], "pattern string, ord int"), part_bytes)
    assert {x.text: x.ord for x in everything.collect()} == {"q": 2, "": 4}


def test_any_number_of_patterns(spark):
    """Beyond what a nested loop did: no refusal, and the same answers as by a few patterns."""
    n = 150_000
    docs = spark.createDataFrame([("path/PART-7-x",), ("none",), (None,), ("part-149999-",), ("barred part-3-",)], "source string")
    many = spark.range(n).selectExpr("concat('part-', id, '-') AS pattern", "id / 8 AS boost", "id AS ord")
    barred = spark.range(n).selectExpr("concat('barred part-', id, '-') AS pattern")
    got = {r.source: r.boost for r in joins.boosted(docs, many, barred).collect()}
    assert got == {"path/PART-7-x": 0.875, "none": 0.95, None: 0.95, "part-149999-": 149999 / 8, "barred part-3-": 0.0}
    kept = predicates.not_blocked(docs, many.select("pattern"))
    assert sorted(str(r.source) for r in kept.collect()) == ["None", "none"] and kept.columns == ["source"]
