"""PII: patterns find protected entities; terms that reveal them are found by what they tell about them.

 1. Patterns find email addresses, IP addresses, card and phone numbers. Each value is a protected entity.
 2. The `words` nearest words on each side of an occurrence, however long they are, are counted by entity, once for each distinct
    context, so that copies of a passage count once. A word is a run of letters and digits outside all spans. Every such
    word is a candidate, however short or rare and however rare the entity; words are terms without regard to case,
    which Spark alone folds, so that all counts speak of the same terms.
 3. A candidate t discloses entity e by P(e|t) and by log2(P(e|t) / P(e)) bits. Terms beyond both thresholds are
    generalised to a placeholder; those that all but name the entity are removed.
     - In at least `support` contexts of e, P(e|t) = n(e, t) / n(t), with n(t) the texts of the whole corpus
       that hold t, or the contexts of all entities that do if these are more.
     - For any pair, rare ones included, also P(e|t) = P(e|k, t) P(k|t) with k the kind of e: P(e|k, t) is e's part of the
       texts that show t by entities of kind k, and P(k|t) = (x(k, t) + prior P(k)) / (n(t) + prior), with x(k, t) the texts that show t by
       an entity of kind k: smoothed by `prior` texts in which k is as frequent as anywhere. The larger estimate counts.
    With a prior of 1, a word that no other text holds is generalised if one value of a kind is by it; a word of
    two texts that is by the value in only one of them stays.

Pair counts are linear in the occurrences, as only a window of words on each
side is paired. Counting is by partial aggregates; candidates, and the sets of terms by text, are broadcast
only if their counted number is small, and joined by shuffle otherwise.

Defined results:
 - null text: empty; empty text: no spans;
 - null or repeated doc_id: each row is judged by its own text; the same text in two rows counts as one in n(t);
 - spans of several kinds that start together: in the order of KINDS; spans may overlap across kinds;
 - very long texts: whole, in linear time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import discard, fits, materialise

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match only ever starts at the start of a number
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: The words that may disclose, for both regular expression engines.
WORD = r"[\p{L}\p{N}]+"
TERM = regex.compile(WORD)

Span = tuple[int, int, int]  # start, number in KINDS, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @."""
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity_of(text: str, span: Span) -> int:
    """A 64-bit hash of the protected value, whatever its spelling."""
    value = text[span[0] : span[2]]
    value = value.lower() if span[1] < 2 else "".join(DIGITS.findall(value))
    return xxhash.xxh3_64_intdigest(f"{KINDS[span[1]]}:{value}") - (1 << 63)


def contexts_of(text: str, spans: list[Span], words: int) -> list[list[str]]:
    """For each span the `words` words before it and behind it, of those that touch no span of the text."""
    if not spans:
        return []
    free, at, end = [], 0, 0  # at, end: the next span and how far those before it reach
    for m in TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            end, at = max(end, spans[at][2]), at + 1
        if m.start() >= end:
            free.append(m)
    starts, ends = [m.start() for m in free], [m.end() for m in free]
    out = []
    for a, _, b in spans:
        i, j = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        out.append([m[0] for m in (*free[max(i - words, 0) : i], *free[j : j + words])])
    return out


def contexts(docs: DataFrame, words: int) -> DataFrame:
    """docs (text) -> kind, entity, context (a hash of its terms), text_hash, terms; a row for each occurrence of an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, entity, hashes, around = [], [], [], []
            for text, text_hash in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                spans = base_spans(text)
                for s, near in zip(spans, contexts_of(text, spans, words), strict=True):
                    kind.append(s[1])
                    entity.append(entity_of(text, s))
                    hashes.append(text_hash.as_py())
                    around.append(near)
            columns = [pa.array(kind, pa.int32()), *(pa.array(c, pa.int64()) for c in (entity, hashes)), pa.array(around, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "entity", "text_hash", "words"])

    docs = docs.select("text", F.xxhash64("text").alias("text_hash"))
    found = docs.mapInArrow(run, "kind int, entity long, text_hash long, words array<string>")
    found = found.select("kind", "entity", "text_hash", F.array_sort(F.array_distinct(F.transform("words", F.lower))).alias("terms"))
    return found.withColumn("context", F.xxhash64("terms"))


def _small(df: DataFrame, rows: int, size: Column | None = None) -> DataFrame:
    return F.broadcast(df) if fits(df, rows, size) else df


def revealing_terms(
    docs: DataFrame, *, words: int = 8, support: int = 3, generalise: float = 0.5, remove: float = 0.9, bits: float = 4.0,
    prior: float = 1.0, broadcast_rows: int = 200_000,
) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash, terms: array of (word as it is written, remove), for the texts that hold revealing terms."""
    docs = docs.select("doc_id", "text")
    total = docs.select(F.xxhash64("text")).distinct().count()
    seen = materialise(contexts(docs, words), "contexts")
    occurrences = seen.groupBy("entity").agg(F.count_distinct("context").alias("n_e"))
    kinds = F.broadcast(seen.groupBy("kind").agg(F.count_distinct("text_hash").alias("x_k")))  # at most four rows
    each = seen.select("kind", "entity", "context", "text_hash", F.explode("terms").alias("term"))
    near = each.groupBy("kind", "entity", "term").agg(
        F.count_distinct("context").alias("n_et"), F.count_distinct("text_hash").alias("x_et")
    )
    near = materialise(near, "near")
    around = near.groupBy("term").agg(F.sum("n_et").alias("n_c"))
    by_kind = near.groupBy("kind", "term").agg(F.sum("x_et").alias("y_kt"))
    by_kind = by_kind.join(each.groupBy("kind", "term").agg(F.count_distinct("text_hash").alias("x_kt")), ["kind", "term"])

    def share(n_t: Column) -> Column:
        """P(e|t) by the number of texts with t; it falls as n_t rises, so a lower bound of n_t gives an upper bound."""
        plain = F.when(F.col("n_et") >= support, F.col("n_et") / F.greatest(n_t, "n_c"))
        kind = (F.col("x_kt") + prior * F.col("x_k") / total) / (n_t + prior)
        return F.greatest(plain, F.col("x_et") / F.col("y_kt") * kind)

    def discloses(n_t: Column) -> Column:
        return (share(n_t) >= generalise) & (F.log2(share(n_t) * total / F.col("n_e")) >= bits)

    pairs = near.join(around, "term").join(by_kind, ["kind", "term"]).join(kinds, "kind").join(occurrences, "entity")
    pairs = materialise(pairs.where(discloses(F.col("x_kt"))), "pairs")
    # A term has at least as many texts as bits of the corpus set in 64; frequent terms are out by that before texts are looked up.
    holds = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word")
    ).withColumn("term", F.lower("word"))
    possible = materialise(pairs.select("term").distinct(), "possible")
    asked = holds.join(_small(possible, broadcast_rows, 32 + F.length("term")), "term")
    marks = asked.groupBy("term").agg(F.expr("bit_count(bit_or(shiftleft(1L, CAST(text_hash & 63 AS INT))))").alias("least"))
    pairs_left = materialise(pairs.join(marks, "term").where(discloses(F.greatest("x_kt", "least"))), "pairs_left")
    candidates = materialise(pairs_left.select("term").distinct(), "candidates")
    held = materialise(holds.join(_small(candidates, broadcast_rows, 32 + F.length("term")), "term"), "held")
    n_t = held.select("term", "text_hash").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    flagged = (
        pairs_left.join(n_t, "term")
        .where(discloses(F.col("n_t")))
        .groupBy("term")
        .agg((F.max(share(F.col("n_t"))) >= remove).alias("remove"))
    )
    flagged = materialise(flagged, "flagged")
    terms = (
        held.join(_small(flagged, broadcast_rows, 32 + F.length("term")), "term")
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.struct("word", "remove"))).alias("terms"))
    )
    terms = materialise(terms, "terms")
    discard(seen, near, pairs, possible, pairs_left, candidates, held, flagged)
    return terms


def find(docs: DataFrame, *, with_text: bool = False, broadcast_rows: int = 200_000, **params) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and, if asked, clean: the sanitised text."""
    docs = docs.select("doc_id", "text")
    terms = revealing_terms(docs, broadcast_rows=broadcast_rows, **params)
    terms = terms.select(F.col("doc_id").alias("id"), "text_hash", "terms")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_hash"))
    words = F.aggregate("terms", F.lit(48), lambda s, x: s + 32 + F.length(x["word"]))
    joined = docs.join(_small(terms, broadcast_rows, words), same, "left").select("doc_id", "text", "terms")
    written = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, terms in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                known = {t["word"]: t["remove"] for t in terms.as_py() or ()}
                drop: dict[Span, bool] = {}
                if known:
                    for m in TERM.finditer(text):
                        if m[0] in known:
                            drop[(m.start(), 4, m.end())] = known[m[0]]
                spans = sorted([*base, *drop])
                counts = [sum(1 for s in base if s[1] == k) for k in range(4)]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append([doc_id.as_py(), *counts, digest, written(spans), *([_clean(text, spans, drop)] if with_text else [])])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)] if rows else []
            yield pa.RecordBatch.from_arrays(columns or [pa.array([], t) for t in kinds.types], schema=kinds)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    kinds = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string())]
    if with_text:
        schema, kinds = f"{schema}, clean string", [*kinds, ("clean", pa.string())]
    kinds = pa.schema(kinds)
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "terms").mapInArrow(run, schema)


def _clean(text: str, spans: list[Span], drop: dict[Span, bool]) -> str:
    """text with each span replaced by its kind in brackets, or removed; a span that overlaps an earlier one goes with it."""
    out, at = [], 0
    for s in spans:
        if s[0] >= at:
            out.append(text[at : s[0]])
            out.append("" if drop.get(s) else f"[{KINDS[s[1]].upper()}]")
        at = max(at, s[2])
    return "".join([*out, text[at:]])
