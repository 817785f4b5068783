"""Interaction of filters: what each one removes, alone and after the others, for every order of them.

Every document gets a mask, a bit for each filter that it fails. One aggregation counts
the documents of each (part, mask); all that follows works on 2^filters counts a part:
 1. the subset-zeta transform adds up, bit by bit, the counts of all masks inside each
    set T, which are the documents that fail no filter outside T: the survivors of its complement;
 2. a step of an order turns the set S of filters before it into S with its own, so what it
    removes is a difference between two neighbouring sets; a Shapley value is a weighted sum of such differences;
 3. the same transform over the counts of good and of toxic documents gives the labels lost at each step.

A filter that depends on the text alone is an expression (`text_filters`, or a function like it). "Identical to a smaller doc_id's
text" depends on the table: rows are counted by (SHA-256 of the text, doc_id), then by digest and part with the number of rows at
their smallest doc_id; what is left of a digest, however many copies it has, is a row for each part and label.

Defined results:
 - null text: empty; null part: the empty string; empty text: fails what its conditions say of zero words and characters;
 - null doc_id: no smaller one is known, so such a row is never a copy and makes none; it has no labels;
 - rows that repeat a doc_id: documents of their own, none a copy of the other;
 - labels that repeat a doc_id: it is good or toxic if any of its rows says so; null labels say nothing;
 - very long texts: whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.llm.common import WHITESPACE

#: The letter of the filter that looks for copies.
COPY = "E"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITESPACE}]+"), lambda w: w != "")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The conditions under which a text without nulls fails, by letter; words is words_of(text)."""
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


#: The text and its words -> the conditions by letter.
Filters = Callable[[Column, Column], dict[str, Column]]


def letters_of(filters: Filters) -> str:
    return "".join(filters(F.lit(""), F.array(F.lit("")))) + COPY


def masked(docs: DataFrame, part: str = "lang", filters: Filters = text_filters) -> DataFrame:
    """docs (doc_id, text, part) -> doc_id, part, digest, mask: bit i is set if the i-th of the filters fails."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    fails = filters(F.col("text"), F.col("words"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())]
    return slim.select("*", words_of(F.col("text")).alias("words")).select(
        "doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), sum(bits[1:], bits[0]).alias("mask")
    )


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: Filters = text_filters) -> DataFrame:
    """part, mask (text filters and, as the highest bit, copies), n, good, toxic: documents of each."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic")))
    )
    rows = masked(docs, part, filters).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    # By digest, part, mask and labels: the rows, those at the smallest doc_id among them, and those without one.
    alike = rows.groupBy("digest", "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("at_low"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
    )
    lowest = F.min("low").over(W.partitionBy("digest"))
    firsts = F.col("no_id") + F.when(F.col("low") == lowest, F.col("at_low")).otherwise(0)
    bit = 1 << len(letters_of(filters)) - 1
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))
    )
    split = alike.select("*", firsts.alias("firsts")).select("part", "good", "toxic", F.explode(both).alias("x"))
    return split.groupBy("part", "x.mask").agg(
        F.sum("x.n").alias("n"), *(F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c) for c in ("good", "toxic"))
    )


def _adds(before: Column, bit: int):
    """One step of the transform, for F.transform(): a mask with the bit gets what the mask without it has."""
    return lambda x, i: x + F.when(i.bitwiseAND(F.lit(bit)) != 0, F.get(before, i.bitwiseXOR(F.lit(bit)))).otherwise(0)


def _found(column: str, measure: str):
    """For F.transform() over masks: what a map has for each, or zero."""
    return lambda i: F.coalesce(F.try_element_at(F.col(column), i)[measure], F.lit(0).cast("long"))


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """What mask_counts() returns -> part and, for n, good and toxic, the array of documents that fail nothing outside each mask."""
    measures = ("n", "good", "toxic")
    dense = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures)))).alias("by_mask"))
    for m in measures:
        dense = dense.withColumn(m, F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), _found("by_mask", m)))
    dense = dense.select("part", *measures)
    for b in range(filters):  # a projection for each bit, so that each step names the arrays of the one before
        dense = dense.select("part", *(F.transform(m, _adds(F.col(m), 1 << b)).alias(m) for m in measures))
    return dense


def order_steps(alive: DataFrame, letters: str) -> DataFrame:
    """What survivors() returns -> a row for each part, order of the letters and step, with what the step does."""
    full, many = (1 << len(letters)) - 1, len(letters)
    orders = F.split(F.lit(" ".join(map("".join, itertools.permutations(letters)))), " ")
    place = lambda x: F.instr(F.col("filter_order"), x)
    before = [F.when(place(x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(letters)]
    shapley = F.expr(f"array({', '.join(_shapley(b, many) for b in range(many))})")
    # Orders and steps are constants of the plan, exploded beside each part.
    rows = alive.select("*", shapley.alias("values"), F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(many))).alias("step"))
    own_bit = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    rows = rows.select("*", own_bit.alias("bit"), sum(before[1:], before[0]).alias("before"))
    rows = rows.select("*", F.get(F.lit([1 << i for i in range(many)]), F.col("bit")).alias("own"))
    own, outside = F.col("own"), F.lit(full) - F.col("before")
    after = outside - own
    at = lambda c, i: F.get(F.col(c), i)
    lost = lambda c: at(c, outside) - at(c, after)
    return rows.select(
        "part", "filter_order", "step",
        at("n", after).alias("kept"), lost("n").alias("removed"),
        (at("n", F.lit(full)) - at("n", F.lit(full) - own) - lost("n")).alias("redundant"),
        (at("n", own) - at("n", F.lit(0))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        at("values", F.col("bit")).alias("shapley"),
    )


def _shapley(bit: int, filters: int) -> str:
    """SQL for what a filter removes, summed over all orders: each set before it counts once for each way to order what is before and after."""
    full, own = (1 << filters) - 1, 1 << bit
    ways = lambda s: factorial(s.bit_count()) * factorial(filters - 1 - s.bit_count())
    return " + ".join(f"{ways(s)} * (n[{full - s}] - n[{full - s - own}])" for s in range(full + 1) if not s & own)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: Filters = text_filters) -> DataFrame:
    """docs (doc_id, text, part, ...), labels (doc_id, quality, toxic) -> what every step of every order of the filters does in each part."""
    letters = letters_of(filters)
    return order_steps(survivors(mask_counts(docs, labels, part, filters), len(letters)), letters)
