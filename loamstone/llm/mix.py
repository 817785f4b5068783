"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Sources in code point order (null last) carry cyclic weights and
   share all words; a target stops at `max_epochs` times its source's size and
   the excess is shared again by weight (water filling in closed form).
2. Blocks. A source's documents stand in the order of a hash of their ids, and
   their words are cut into blocks of `block_words`. A target takes all blocks as many times as
   its source fits in; of one more epoch it draws blocks in a random order (that of a hash
   of seed, source, epoch and block) until the words left over are reached, the last one in part. These blocks are the source's quota.
3. Tree. The root holds every source's quota. A node deals half its blocks to
   its left child; how many of them come from each source is one draw of the
   multivariate hypergeometric distribution, so every shard gets an exact
   count of blocks and the counts of a uniformly random deal, without moving
   any data. Sources are dealt in groups, first the groups and then the sources of each, so no array is longer than
   about the square root of their number.
4. The drawn blocks of a source are permuted by another hash, and each leaf takes as many of them as it was dealt,
   no block twice; a shard orders its blocks by hash. What a document gives is the sum over the shards' blocks.

All steps are DataFrame expressions. Ranks and prefix sums over a source go by hash
bucket first, so a source with a third of all rows is spread over 4,096 groups.
No rows or blocks are ever gathered by source.

Defined results:
 - null or blank text: size 0, taken 0; null source: a source of its own, the last;
 - null doc_id: hashed as the empty string;
 - repeated rows and ids: each row is a document of its own; ties in hash go by id, then size;
 - very long documents: cut at block ends, the last block of a draw is cut at its target;
 - an empty table gives an empty result; no other column is read, but for those that `carry` names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.llm.common import let, materialise, unit_hash

WEIGHTS = (5, 2, 1)
#: Blocks that one row is unfolded into.
GROUP = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, size) rows -> source, source_size, target, words (the target as whole words), one row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.select("source", "source_size", place.alias("place"), weight.alias("weight"))
    cap = F.col("source_size") * float(max_epochs)
    order = W.orderBy((cap / F.col("weight")).asc(), "place")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    by = by.select("*", level.alias("level"), F.row_number().over(order).alias("rank"))
    first = F.min(F.when(cap / F.col("weight") >= F.col("level"), F.struct("rank", "level"))).over(every)
    by = by.select("source", "source_size", "weight", first["level"].alias("level"))
    target = F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap))
    return by.select("source", "source_size", target.alias("target"), F.round(target).cast("long").alias("words"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` units out of `total`, of which `marked` are marked, are marked: inverse transform of u.

    Probabilities are built up from the mode by their ratios; beyond 12
    standard deviations and 24 units more they are below a double's precision.
    """
    total, marked, drawn = (c.cast("double") for c in (total, marked, drawn))
    mode = F.floor((drawn + 1) * (marked + 1) / (total + 2)).cast("double")
    var = drawn * marked / total * (1 - marked / total) * (total - drawn) / F.greatest(total - 1, F.lit(1.0))
    half = F.ceil(12 * F.sqrt(F.greatest(var, F.lit(0.0)))) + 24
    known = F.struct(
        mode.cast("long").alias("mode"),
        F.greatest(F.lit(0.0), drawn + marked - total, mode - half).cast("long").alias("lo"),
        F.least(drawn, marked, mode + half).cast("long").alias("hi"),
    )

    def up(x):  # p(x + 1) / p(x)
        return (marked - x) * (drawn - x) / ((x + 1) * (total - marked - drawn + x + 1))

    def down(x):  # p(x - 1) / p(x)
        return x * (total - marked - drawn + x) / ((marked - x + 1) * (drawn - x + 1))

    def pick(k):
        def fold(xs, first, ratio, cum, goal):
            def step(s, x):
                now = s["cum"] + s["w"]
                hit = F.when(s["hit"].isNull() & (now >= goal), x).otherwise(s["hit"])
                return F.struct((s["w"] * ratio(x.cast("double"))).alias("w"), now.alias("cum"), hit.alias("hit"))

            zero = F.struct(first.alias("w"), cum.alias("cum"), F.lit(None).cast("long").alias("hit"))
            return F.aggregate(xs, zero, step)

        ups = F.sequence(k["mode"], k["hi"])
        downs = F.when(
            k["lo"] < k["mode"], F.sequence(k["mode"] - 1, k["lo"], F.lit(-1).cast("long"))
        ).otherwise(F.array().cast("array<long>"))
        one, zero, never = F.lit(1.0), F.lit(0.0), F.lit(float("inf"))
        below = down(k["mode"].cast("double"))
        mass = fold(downs, below, down, fold(ups, one, up, zero, never)["cum"], never)["cum"]
        return let(
            mass * u,
            lambda goal: let(
                fold(ups, one, up, zero, goal),
                lambda s: F.coalesce(s["hit"], fold(downs, below, down, s["cum"], goal)["hit"], k["mode"]),
            ),
        )

    return F.when(marked * drawn <= 0, F.lit(0).cast("long")).otherwise(let(known, pick))


def _deal(items: Column, drawn: Column, *seed: Column) -> Column:
    """How many of `drawn` blocks come from each of the items (k, blocks), one after another, as an array."""
    every = F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
    start = F.struct(every.alias("m"), drawn.cast("long").alias("n"), F.array().cast("array<long>").alias("out"))

    def one(state, item):
        x = hypergeometric(state["m"], item["blocks"], state["n"], unit_hash(*seed, item["k"]))
        return let(
            x,
            lambda v: F.struct(
                (state["m"] - item["blocks"]).alias("m"), (state["n"] - v).alias("n"), F.concat(state["out"], F.array(v)).alias("out")
            ),
        )

    return F.aggregate(items, start, one)["out"]


def splitting_tree(quotas: DataFrame, depth: int, seed: int, group_sources: int = 256) -> DataFrame:
    """(source, blocks) -> shard, source, blocks: the exact counts of 2 ** depth shards.

    A node is a row for each group of sources. Its draw is made in two steps that give the same distribution as one:
    how many of the left child's blocks come from each group, then how many of a group's come from each source.
    """
    sources = quotas.where(F.col("blocks") > 0).select(F.coalesce("source", F.lit("")).alias("k"), "source", "blocks")
    n = sources.count()
    groups = -(-n // group_sources)
    if groups > group_sources:
        groups = int(n**0.5)
    by_group = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(max(groups, 1))).cast("int")
    rows = sources.groupBy(by_group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "source", "blocks"))).alias("q"))
    rows = rows.select(F.lit(0).cast("long").alias("node"), "g", "q")
    total = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
    for _ in range(depth):
        if groups > 1:
            rows = materialise(rows, "tree")
            shares = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("k"), total("q").alias("blocks")))).alias("gs"))
            every = F.aggregate("gs", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
            shares = shares.select("node", "gs", _deal(F.col("gs"), F.ceil(every / 2), F.lit(seed), F.lit("group"), F.col("node")).alias("out"))
            shares = shares.select("node", F.inline(F.arrays_zip(F.transform("gs", lambda x: x["k"]).alias("g"), F.col("out").alias("drawn"))))
            rows = rows.join(shares, ["node", "g"])
        else:
            rows = rows.withColumn("drawn", F.ceil(total("q") / 2).cast("long"))
        rows = rows.select("node", "g", "q", _deal(F.col("q"), F.col("drawn"), F.lit(seed), F.col("node")).alias("left"))

        def child(bit, count):
            q = F.zip_with(
                "q", "left", lambda a, b: F.struct(a["k"].alias("k"), a["source"].alias("source"), count(a, b).alias("blocks"))
            )
            return F.struct((F.col("node") * 2 + bit).alias("node"), F.col("g"), q.alias("q"))

        both = F.array(child(0, lambda a, b: b), child(1, lambda a, b: a["blocks"] - b))
        rows = materialise(rows.select(F.inline(both)), "tree")
    leaf = rows.select(F.col("node").alias("shard"), F.explode("q").alias("x"))
    return leaf.select("shard", "x.source", "x.blocks").where(F.col("blocks") > 0)


def prefix(rows: DataFrame, keys: list[str], h: str, value: Column | None = None) -> DataFrame:
    """rows with `before`: the sum of value (by default the number) of the rows of the same keys, source first, that come before in the order of the
    hex digest h. Two levels: 256 buckets of the digest, then the rows of each; blocks are some thousand times fewer than words."""
    name = [f"_k{i}" for i in range(len(keys))]
    rows = rows.withColumn("_b", F.substring(h, 1, 2)).withColumn("_v", F.lit(1).cast("long") if value is None else value)
    inside = W.partitionBy(*keys, "_b").orderBy(h).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    sums = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, name, strict=True)], F.col("_b").alias("_s")).agg(F.sum("_v").alias("_w"))
    upto = W.partitionBy(*name).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*name, "_s", F.coalesce(F.sum("_w").over(upto), F.lit(0)).alias("_o"))
    same = F.col("_b") == F.col("_s")
    for k, n in zip(keys, name, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(sums, same).withColumn("before", (F.col("_o") + F.col("_in")).cast("long")).drop("_b", "_v", "_in", "_s", "_w", "_o", *name)


def draw_epochs(goal: DataFrame, block_words: int, seed: int) -> DataFrame:
    """(source, source_size, words) -> source, epoch, block, n: the blocks that make each target's words, and how many words of each."""
    size, words = F.col("source_size"), F.col("words")
    epochs = goal.where((size > 0) & (words > 0)).select(
        "source", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((words - 1) / size))).alias("epoch"), "words"
    )
    left = F.least(size, words - F.col("epoch") * size)
    last = F.floor((size - 1) / block_words)  # of the blocks
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / GROUP))).alias("chunk")
    chunks = epochs.select("source", "source_size", "epoch", left.alias("left"), last.alias("last"), chunks).repartition("source", "epoch", "chunk")
    some = F.sequence(F.col("chunk") * GROUP, F.least(F.col("last"), F.col("chunk") * GROUP + GROUP - 1))
    blocks = chunks.select("source", "source_size", "epoch", "left", F.explode(some).alias("block"))
    n = F.least(F.lit(block_words).cast("long"), size - F.col("block") * block_words)
    blocks = blocks.select("source", "epoch", "block", n.alias("n"), "left", (F.col("left") < size).alias("part"))
    whole = blocks.where("NOT part").select("source", "epoch", "block", "n")
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("epoch").cast("string"), F.col("block").cast("string"))
    order = prefix(blocks.where("part").withColumn("h", F.md5(name)), ["source", "epoch"], "h", F.col("n"))
    drawn = order.select("source", "epoch", "block", F.greatest(F.lit(0), F.least("n", F.col("left") - F.col("before"))).cast("long").alias("n"))
    return whole.unionByName(drawn.where("n > 0"))


def draw_blocks(items: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """items (source, epoch, block, n), leaves (shard, source, blocks) -> items with their shard: each source's items, permuted and dealt out disjointly."""
    h = F.md5(F.concat_ws("|", F.lit(f"{seed}|shard"), F.coalesce("source", F.lit("")), F.col("epoch").cast("string"), F.col("block").cast("string")))
    ranked = prefix(items.withColumn("h", h), ["source"], "h").drop("h")
    upto = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    places = leaves.select("shard", F.col("source").alias("s"), F.coalesce(F.sum("blocks").over(upto), F.lit(0)).alias("first"), "blocks")
    places = places.select("shard", "s", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("place"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("before") == F.col("place"))
    return ranked.join(places, same).select("source", "epoch", "block", "n", "shard")


def placed(rows: DataFrame, seed: int) -> DataFrame:
    """rows with doc_id, source, size -> with bucket, slot (a row's place in its bucket) and start (words before it)."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("h", F.md5(name)).withColumn("bucket", F.substring("h", 1, 3))
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    rows = rows.select(
        "*",
        F.row_number().over(inside).alias("slot"),
        F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("local"),
    )
    return rows.drop("h")


def mix(
    docs: DataFrame,
    *,
    weights=WEIGHTS,
    max_epochs: int = 3,
    block_words: int = 4096,
    blocks_a_shard: int = 4096,
    seed: int = 0,
    carry: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, source, size, ...) -> (rows, pieces).

    rows: doc_id, source, size, the columns named in `carry` as the struct `carried`, bucket, slot, source_size, target.
    pieces: shard, order_key, source, bucket, slot, epoch, first and n: the shard takes n words from
    word `first` of that row, blocks in the order of order_key.
    """
    docs = docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), F.struct(*(carry or [F.lit(None).alias("none")])).alias("carried"))
    goal = materialise(targets(docs.select("source", "size"), weights, max_epochs), "targets")
    items = materialise(draw_epochs(goal, block_words, seed), "items")
    blocks = items.count()
    depth = max(0, (max(1, -(-blocks // blocks_a_shard)) - 1).bit_length())
    quotas = items.groupBy("source").agg(F.count("*").alias("blocks"))
    drawn = materialise(draw_blocks(items, splitting_tree(quotas, depth, seed), seed), "drawn")

    rows = placed(docs, seed)
    sums = (
        rows.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words_in"))
        .select(
            F.col("source").alias("s"),
            F.col("bucket").alias("b"),
            F.coalesce(
                F.sum("words_in").over(
                    W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("offset"),
        )
    )
    goals = goal.select(F.col("source").alias("g"), "source_size", "target")
    sums = sums.join(goals, F.col("s").eqNullSafe(F.col("g"))).drop("g")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    start = F.col("offset") + F.col("local")
    spans = F.sequence(F.floor(start / block_words), F.floor((start + F.col("size") - 1) / block_words))
    over = rows.where("size > 0").select("source", "bucket", "slot", "size", start.alias("start"), F.explode(spans).alias("block"))
    dealt = drawn.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", F.col("n").alias("upto"), "shard")
    flat = over.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    first = F.greatest(F.col("block") * block_words, F.col("start"))
    end = F.least(F.col("block") * block_words + F.col("upto"), F.col("start") + F.col("size"))
    key = F.xxhash64(F.lit(seed), F.col("shard"), F.col("source"), F.col("epoch"), F.col("block"))
    pieces = flat.where(end > first).select(
        "shard", key.alias("order_key"), "source", "bucket", "slot", F.col("epoch").cast("int").alias("epoch"),
        (first - F.col("start")).cast("long").alias("first"), (end - first).cast("long").alias("n"),
    )
    return rows.drop("local", "offset"), pieces


def taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """rows with `taken`: the words that all shards take of each."""
    sums = pieces.groupBy(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("slot").alias("l")
    ).agg(F.sum("n").alias("taken"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("slot") == F.col("l"))
    return rows.join(sums, same, "left").drop("s", "b", "l").withColumn("taken", F.coalesce("taken", F.lit(0)))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that the mix takes words of, with size, source_size, target, taken and placements.

    placements: an array of (shard, order_key, epoch, first, n). Columns of docs by these names are replaced.
    Rows are numbered as they are written, so texts move once, to meet what is decided about them.
    """
    new = ["size", "source_size", "target", "taken", "placements"]
    numbered = docs.select(
        F.monotonically_increasing_id().alias("id"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row")
    )
    numbered = materialise(numbered, "numbered")
    rows, pieces = mix(numbered.select("id", "doc_id", "source", "size"), carry=("id",), **params)
    placed = pieces.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("slot").alias("l")).agg(
        F.sum("n").alias("taken"),
        F.array_sort(F.collect_list(F.struct("shard", "order_key", "epoch", "first", "n"))).alias("placements"),
    )
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("slot") == F.col("l"))
    rows = rows.select(F.col("carried.id").alias("id"), *new[:3], "source", "bucket", "slot")
    placed = materialise(rows.join(placed, same).select("id", *new), "placed")
    out = numbered.select("id", "row").join(placed.hint("merge"), "id")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *new)
