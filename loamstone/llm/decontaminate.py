"""Benchmark decontamination by winnowing.

Both sides are cut into words; a fingerprint is the smallest hash of the
k-grams in a sliding window of `window` words. Two texts that share a window
share its smallest k-gram hash, so every shared span of `window` words is
found whatever stands around it. The method has three steps:
 1. both sides keep a fingerprint for each window; the documents' distinct ones are joined with the items';
 2. in documents with hits, the positions whose fingerprint was hit are candidate windows;
 3. a hit is extended to its window and compared with the items' windows word by word, so hash
    collisions cost time only.

Items shorter than `window` words are one window each. They hold too few words
for the guarantee, so each of their lengths (fewer than `window`) is compared
at every position of the documents.

What is broadcast has been counted: at most `broadcast_rows` rows and common.BROADCAST_BYTES bytes; beyond that the join
shuffles. Items are gathered by window before documents meet them, so a passage that D documents and M items share
makes D rows and not D * M.

Defined results:
 - null or empty text, or one without words: no words, never contaminated; an item without words matches nothing;
 - repeated items: each item_id counts; rows that repeat an item_id are several texts of one item;
 - null item_id: its windows count as hits but it cannot be listed;
 - rows that repeat a doc_id (null included): each row is judged by its own text;
 - very long texts: whole; empty tables: no rows, or nothing contaminated; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import ascii_fold, fits, let, materialise

#: Runs of word characters of the byte image of a text: digits, small letters and all that is not ASCII.
#: Each is listed, since Java looks up single characters in a bit set but tries ranges one by one.
WORD = "[" + "".join(f"\\x{c:02x}" for c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100))) + "]+"


def words_of(text: Column) -> Column:
    """The words as their byte images, in order (see ascii_fold)."""
    return F.regexp_extract_all(F.coalesce(ascii_fold(text), F.lit("")), F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(ascii_fold(text), F.lit(WORD)), F.lit(0)).cast("long")


def positions(n: Column, span: Column | int) -> Column:
    """1 .. n - span + 1, empty if the text is shorter."""
    return F.when(n >= span, F.sequence(F.lit(1), n - span + 1)).otherwise(F.array().cast("array<int>"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def gram_hashes(hashes: Column, span: int) -> Column:
    """Hashes of the runs of `span` words, by first word; of single elements, as slices would copy every word span times."""
    return F.transform(positions(F.size(hashes), span), lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(span)]))


def window_minima(hashes: Column, window: int, k: int) -> Column:
    """The smallest hash among the k-grams of each run of `window` words, by its first word."""
    per = window - k + 1
    if per == 1:
        return gram_hashes(hashes, k)

    def minima(grams: Column) -> Column:
        return F.transform(positions(F.size(grams), per), lambda i: F.least(*[F.element_at(grams, i + j) for j in range(per)]))

    return let(gram_hashes(hashes, k), minima)


def contamination(
    docs: DataFrame, items: DataFrame, *, window: int = 10, k: int = 5, broadcast_rows: int = 200_000
) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> doc_id, text_hash, n_hit, item_ids.

    One row for each distinct contaminated (doc_id, text); text_hash is
    xxhash64(text), n_hit counts the words inside any occurrence of an item's
    window, and item_ids is the sorted array of the items found, as strings.
    """

    def small(df: DataFrame, size: Column | None = None) -> DataFrame:
        return F.broadcast(df) if fits(df, broadcast_rows, size) else df

    item_words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    item_words = materialise(item_words.where(F.size("w") > 0), "items")
    span = F.least(F.size("w"), F.lit(window))
    spans = F.transform(positions(F.size("w"), span), lambda i: F.concat_ws(" ", F.slice("w", i, span)))
    windows = item_words.select("item", span.alias("span"), F.explode(spans).alias("win"))
    windows = materialise(windows.groupBy("span", "win").agg(F.collect_set("item").alias("items")), "windows")
    # At most window - 1 numbers: the lengths of items that are shorter than a window.
    short = sorted(r[0] for r in item_words.where(F.size("w") < window).select(F.size("w")).distinct().collect())

    def prints_of(w: Column) -> Column:
        return let(word_hashes(w), lambda h: F.array_distinct(F.concat(window_minima(h, window, k), *[gram_hashes(h, n) for n in short])))

    def own(h: Column) -> Column:
        whole = F.lit(None)  # a short item's print is that of all its words
        for n in short:
            whole = F.when(F.size(h) == n, gram_hashes(h, n)).otherwise(whole)
        return F.when(F.size(h) < window, whole).otherwise(window_minima(h, window, k))

    prints = materialise(item_words.select(F.explode(let(word_hashes(F.col("w")), own)).alias("print")).distinct(), "prints")

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    hits = (
        texts.select("doc_id", "text_hash", F.explode(let(words_of(F.col("text")), prints_of)).alias("print"))
        .join(small(prints), "print")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("print").alias("hits"))
    )
    hits = materialise(hits.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "hits"), "hits")
    small_hits = small(hits, 32 + 8 * F.size("hits"))
    hit_texts = texts.join(small_hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")))
    hit_texts = hit_texts.select("doc_id", "text_hash", "text", "hits").dropDuplicates(["doc_id", "text_hash"])

    def candidates(w: Column) -> Column:
        def of(span: int, hashes: Column) -> Column:
            marked = F.transform(
                hashes,
                lambda h, i: F.when(
                    F.array_contains("hits", h),
                    F.struct(
                        (i + 1).alias("first"),
                        F.lit(span).alias("span"),
                        F.concat_ws(" ", F.slice(w, i + 1, span)).alias("win"),
                    ),
                ),
            )
            return F.filter(marked, lambda x: x.isNotNull())

        return let(word_hashes(w), lambda h: F.concat(of(window, window_minima(h, window, k)), *[of(n, gram_hashes(h, n)) for n in short]))

    at = hit_texts.select("doc_id", "text_hash", F.explode(let(words_of(F.col("text")), candidates)).alias("c"))
    names = F.aggregate("items", F.lit(0), lambda s, x: s + 16 + F.length(x))
    found = at.select("doc_id", "text_hash", "c.first", "c.span", "c.win").join(small(windows, 32 + F.length("win") + names), ["span", "win"])
    covered = F.flatten(F.transform("places", lambda p: F.sequence(p["first"], p["first"] + p["span"] - 1)))
    # Windows of one passage have one array of items, which collect_set keeps once.
    found = found.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("first", "span")).alias("places"), F.collect_set("items").alias("items")
    )
    ids = F.array_sort(F.array_distinct(F.flatten("items")))
    return found.select("doc_id", "text_hash", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), ids.alias("item_ids"))


def judged(docs: DataFrame, found: DataFrame, how: str, broadcast_rows: int = 200_000) -> DataFrame:
    """docs joined with what contamination() found, which must be materialised."""
    names = F.aggregate("item_ids", F.lit(0), lambda s, x: s + 16 + F.length(x))
    small = F.broadcast(found) if fits(found, broadcast_rows, 32 + names) else found
    small = small.select(F.col("doc_id").alias("_found_id"), F.col("text_hash").alias("_found_hash"), "n_hit", "item_ids")
    same = docs["doc_id"].eqNullSafe(small["_found_id"]) & (F.xxhash64(docs["text"]) == small["_found_hash"])
    return docs.join(small, same, how)


def without_contaminated(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """docs without the rows that hold a window of an item."""
    found = materialise(contamination(docs, items, **params), "contaminated")
    return judged(docs, found, "left_anti")
