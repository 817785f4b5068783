import pytest
from pyspark.sql import functions as F

from loamstone.llm import mix
from tests.llm.helpers import docs, random_texts


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    free, got, left = set(names), {}, float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]} if total else set()
        if not over:
            return {**got, **{s: left * weight[s] / total for s in free}}
        for s in over:
            got[s] = 3.0 * sizes[s]
            left -= got[s]
        free -= over


def table(spark):
    rows = [(i, t, ["a", "b", "c", "é", "z", None][i % 17 % 6]) for i, t in enumerate(random_texts(300, 4))]
    rows += [(900, None, "a"), (901, "", None), (None, "one two", "b"), (None, "one two", "b"), (5, "x y z", "a"), (5, "x y z", "a"), (902, "w " * 20_000, "a")]
    return docs(spark, rows).select("doc_id", "source", mix.word_count(F.col("text")).alias("size"))


def run(spark, df, **params):
    rows, pieces = mix.mix(df, **params)
    return rows, pieces, mix.taken(rows, pieces)


def test_targets_and_words(spark):
    df = table(spark)
    rows, pieces, taken = run(spark, df, block_words=16, blocks_a_shard=50)
    got = taken.collect()
    assert len(got) == df.count()
    sizes = {r.source: r.source_size for r in got}
    want = brute_targets(sizes)
    by = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        by[r.source] = by.get(r.source, 0) + r.taken
    for s, n in by.items():
        assert abs(n - want[s]) <= 1
    again = run(spark, df.repartition(5), block_words=16, blocks_a_shard=50)[2]
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(repr, again.select(*key).collect())) == sorted(map(repr, taken.select(*key).collect()))


@pytest.mark.parametrize("group_sources", [256, 2, 1])
def test_shards_are_even_and_disjoint(spark, group_sources):
    goal = mix.targets(table(spark).select("source", "size"))
    items = mix.draw_epochs(goal, 16, 0)
    quota = items.groupBy("source").agg(F.count("*").alias("blocks"))
    leaves = mix.splitting_tree(quota, 4, 0, group_sources)
    sizes = [r[0] for r in leaves.groupBy("shard").agg(F.sum("blocks")).select("sum(blocks)").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1
    back = leaves.groupBy("source").agg(F.sum("blocks").alias("n"))
    assert {r.source: r.n for r in back.collect()} == {r.source: r.blocks for r in quota.collect()}
    drawn = mix.draw_blocks(items, leaves, 0).collect()
    assert sorted((repr(r.source), r.epoch, r.block, r.n) for r in drawn) == sorted((repr(r.source), r.epoch, r.block, r.n) for r in items.collect())
    dealt = {}
    for r in drawn:
        dealt[r.shard, r.source] = dealt.get((r.shard, r.source), 0) + 1
    assert dealt == {(r.shard, r.source): r.blocks for r in leaves.collect()}


def test_blocks_of_the_last_epoch_are_drawn_at_random(spark):
    """Each target to the word; of an epoch in part, blocks in no order and others for another seed."""
    goal = spark.createDataFrame([("a", 1600, 100.0, 100), (None, 1601, 1701.0, 1701), ("c", 7, 21.0, 21), ("d", 0, 0.0, 0)], "source string, source_size long, target double, words long")
    picked = {}
    for seed in (0, 1):
        rows = mix.draw_epochs(goal, 16, seed).collect()
        for name, _, _, words in goal.collect():
            assert sum(r.n for r in rows if r.source == name) == words
        assert len({(r.source, r.epoch, r.block) for r in rows}) == len(rows)
        picked[seed] = sorted(r.block for r in rows if r.source == "a")
        assert len(picked[seed]) == 7 and picked[seed] != list(range(7))
        assert sorted(r.block for r in rows if r.source is None and r.epoch == 0) == list(range(101))
    assert picked[0] != picked[1]


def test_what_is_taken_comes_through_the_tree(spark, monkeypatch):
    """Without some leaves, their words are not taken; by a plain version that walks the shards."""
    df, real = table(spark), mix.splitting_tree
    rows, pieces, taken = run(spark, df, block_words=16, blocks_a_shard=50)
    per = {}
    for p in pieces.collect():
        per.setdefault((p.source, p.bucket, p.slot), []).append((p.shard, p.epoch, p.first, p.n))
    for r in taken.collect():
        own = per.get((r.source, r.bucket, r.slot), [])
        assert r.taken == sum(n for _, _, _, n in own)
        for epoch in range(3):  # no word twice in an epoch
            spans = sorted((first, first + n) for _, e, first, n in own if e == epoch)
            assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False)) and all(0 <= a < b <= r.size for a, b in spans)
    every = taken.agg(F.sum("taken")).first()[0]
    monkeypatch.setattr(mix, "splitting_tree", lambda *a: real(*a).where("shard % 2 = 0"))
    half = run(spark, df, block_words=16, blocks_a_shard=50)[2].agg(F.sum("taken")).first()[0]
    assert 0.3 * every < half < 0.7 * every


def test_permutation_is_no_identity(spark):
    for count in (2, 6, 7, 18, 77, 151):
        goal = spark.createDataFrame([("a", 16 * count, 0.0, 16 * count)], "source string, source_size long, target double, words long")
        items = mix.draw_epochs(goal, 16, 0)
        leaves = spark.createDataFrame([(i, "a", 1) for i in range(count)], "shard long, source string, blocks long")
        order = [r.block for r in mix.draw_blocks(items, leaves, 0).orderBy("shard").collect()]
        assert sorted(order) == list(range(count)) and (count == 2 or order != sorted(order))


def test_clashing_columns_are_not_read(spark):
    df = table(spark).select("*", *[F.lit(7).alias(c) for c in ("h", "bucket", "slot", "local", "offset", "words", "s", "b", "before", "carried")])
    key = ["doc_id", "source", "size", "taken"]
    got = run(spark, df, block_words=16)[2].select(*key)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, run(spark, table(spark), block_words=16)[2].select(*key).collect()))


def test_hypergeometric_draws_have_their_distribution(spark):
    total, marked, drawn = 60, 25, 18
    u = (F.col("id") + 0.5) / 4000
    x = mix.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), u)
    found = spark.range(4000).select(x.alias("x")).agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
    p = marked / total
    assert found[0] == pytest.approx(drawn * p, abs=0.02)
    assert found[1] == pytest.approx(drawn * p * (1 - p) * (total - drawn) / (total - 1), rel=0.03)
    assert found[2] >= 0 and found[3] <= drawn
    for t, m, d, want in ((10, 10, 4, 4), (10, 0, 4, 0), (10, 3, 10, 3), (10, 3, 0, 0), (1, 1, 1, 1)):
        assert spark.range(1).select(mix.hypergeometric(F.lit(t), F.lit(m), F.lit(d), F.lit(0.37))).first()[0] == want


def test_empty_and_blank_tables(spark):
    kind = "doc_id long, source string, size long"
    assert run(spark, spark.createDataFrame([], kind))[2].count() == 0
    blank = run(spark, spark.createDataFrame([(1, "a", 0), (2, None, 0)], kind))[2].collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2


def test_mixed_documents_keep_columns(spark):
    before = docs(spark, [(i, f"some words {i}", "ab"[i % 2]) for i in range(40)])
    after = mix.mixed_documents(before)
    assert {"doc_id", "text", "row", "taken", "placements"} <= set(after.columns) and len(set(after.columns)) == len(after.columns)
    r = after.first()
    assert r.text.startswith("some words") and r.taken == sum(p.n for p in r.placements) and r.size == 3 and r.row == "x"
