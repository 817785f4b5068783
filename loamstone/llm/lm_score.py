"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

A count c is quantised to the level q(c): 1, 2, ... by thresholds that grow by `base`. The filter holds the
keys (n-gram, 1) ... (n-gram, q); a count is read back by probing levels until one is missing, so an error can only
raise it, and each level more has the filter's small error rate again. Probabilities are smoothed towards those of shorter n-grams,
 P(w | h) = (c(hw) + mu * P(w | h')) / (c(h) + mu), at the end P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)),
with all c read from the filter, a c(hw) above its c(h) taken as c(h), and N and V exact.

The corpus is counted in tasks: each batch of texts gives its distinct n-grams with counts, grouped by the segment of
the filter that their hash falls into; a segment is built in a task of its own from those and sized by its own keys. The number of
segments follows the number of tokens, so a task's share stays the same at every size.
train() and score() are apart, for a model that scores other texts than it learned from. Up to `filter_bytes` the filter is
broadcast and texts are scored in one pass. Beyond that the distinct n-grams of a chunk of texts meet the segments in a shuffle,
and levels travel back to their chunk; both ways give the same scores.

fitted_scores() learns from some rows of a table and scores them all. There the n-grams are sent once, to be counted and asked for
together: a segment is built and probed where it is built. Texts are stored once, by chunk; an n-gram of two words or more is
sent as 40 bits within its segment, a word as it is, both once a chunk, and what comes back is a byte or so for each; a word that
nothing was learned from is told by its exact count. Nothing is
broadcast, so disk and memory grow with the input alone.

The exact unigram sum needs exact counts of words, by the words themselves. In score() those of the HEAD most frequent (short) words are
broadcast, the words beyond are joined by a shuffle; which word goes which way does not change a result.

Defined results:
 - null or empty text: the end token alone; null doc_id: held out, as its text counts as empty;
 - repeated ids and rows: each row is learned from or scored by itself; a very long text: whole;
 - A-Z are lower-cased, nothing else; words that are not in the training rows have c = 0;
 - no training rows: every token has probability 1 under the base, and the same under the model;
 - an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import discard, materialise, materialise_sorted
from loamstone.llm.textvec import chunks, folded, mix64, release_memory, span_hashes, word_numbers, words

U = np.uint64
#: Words whose exact counts are broadcast, and the bytes that such a word has at most.
HEAD, HEAD_WORD = 1 << 16, 64
#: Bytes of a filter that is broadcast, at most.
FILTER_BYTES = 128 << 20
#: n-gram tokens of the corpus for each segment of the filter.
SEGMENT_TOKENS = 1 << 21
#: Tokens that a task counts together.
COUNTED = 1 << 21
#: Bytes of the texts of a chunk, of which each distinct n-gram is sent once; a longer text is a chunk of its own.
DEALT_BYTES = 12 << 20
#: Bits of an n-gram's hash within its segment.
KEY_BITS = U(40)
#: Stands for the end of a text, in front of which there is one as well; words are never empty.
END = b""
_END_HASH = U(0x5851F42D4C957F2D)
_STEP = 0x9E3779B97F4A7C15
#: An n-gram's hash picks its segment by this multiple, so that places in a segment stay independent of it.
_SEGMENT = U(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Shape:
    """Parameters of model and filter."""

    order: int = 2
    mu: float = 100.0
    base: float = 1.5
    bits: int = 10
    hashes: int = 6

    def thresholds(self) -> np.ndarray:
        """The least count of each level."""
        out, x = [1], 1.0
        while out[-1] < 1 << 62:
            x *= self.base
            if (t := int(np.ceil(x))) > out[-1]:
                out.append(t)
        return np.array(out, dtype=np.int64)

    def levels(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.thresholds(), counts, side="right")

    def estimates(self) -> np.ndarray:
        """The count that stands for each level; 0 for none."""
        t = self.thresholds().astype(np.float64)
        return np.concatenate([[0.0], (t[:-1] + t[1:] - 1) / 2, t[-1:]])


def trains(doc_id: Column) -> Column:
    """Whether a row is learned from: crc32 of its id as text, modulo 10, is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 != 0


# ---- texts to n-grams, in tasks


@dataclass
class Grams:
    """The n-grams of some texts. A text is laid out as END, its words, END; its tokens are all of these but the first."""

    #: [k][i]: the hash of the k + 1 entries that end with entry i, if the text has as many up to there.
    hashes: list[np.ndarray]
    #: Of each entry, its place in its text.
    place: np.ndarray
    #: Of each word, its entry.
    at: np.ndarray
    #: Of each text, its first token, and after the last text the number of all.
    rows: np.ndarray


def grams(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, rows: np.ndarray, order: int) -> Grams:
    """folded() bytes with words and each row's first word."""
    counts = np.diff(rows)
    base = np.concatenate([[0], np.cumsum(counts + 2)]).astype(np.int64)
    at = np.arange(len(starts)) + np.repeat(base[:-1] - rows[:-1] + 1, counts)
    laid = np.full(base[-1], _END_HASH, dtype=U)
    laid[at] = span_hashes(data, starts, stops)
    chained = [mix64(laid + U(1))]
    for k in range(1, order):
        before = np.concatenate([np.zeros(1, dtype=U), chained[-1][:-1]])
        chained.append(mix64(before * U(0xBF58476D1CE4E5B9) + laid + U(k + 1)))
    return Grams(chained, np.arange(len(laid)) - np.repeat(base[:-1], counts + 2), at, base - np.arange(len(base)))


def _hashes_of(given: list[bytes]) -> np.ndarray:
    """The unigram hashes of words as they are, END among them."""
    stops = np.cumsum([len(w) for w in given]).astype(np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    hashes = span_hashes(folded(np.frombuffer(b"".join(given), dtype=np.uint8)), starts, stops)
    return mix64(np.where(stops == starts, _END_HASH, hashes) + U(1))


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    """(batch, first row, folded bytes, starts, stops, rows) of runs of rows."""
    for batch in batches:
        for first, data, offsets in chunks(batch.column(column)):
            starts, stops, rows = words(data, offsets)
            yield batch, first, folded(data), starts, stops, rows


def _distinct_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the first place of each, and for each word its number among them."""
    number = word_numbers(data, starts, stops)
    first = np.zeros(int(number.max(initial=-1)) + 1, dtype=np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    a, size = starts[first], (stops - starts)[first]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], size)
    found = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())])
    return found, first, number


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (text) -> word binary, n: the tokens of all texts, END included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data, starts, stops, rows in _texts(batches, 0):
            found, _, number = _distinct_words(data, starts, stops)
            n = np.concatenate([np.bincount(number, minlength=len(found)), [len(rows) - 1]])
            found = pa.concat_arrays([found.cast(pa.binary()), pa.array([END], pa.binary())])
            yield pa.RecordBatch.from_arrays([found, pa.array(n, pa.int64())], ["word", "n"])
        release_memory()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, many: int = HEAD) -> DataFrame:
    """At most so many of the most frequent short words: those of n >= 2^e, for the smallest e that leaves no more."""
    short = counts.where(F.length("word") <= HEAD_WORD)
    widths = dict(short.groupBy(F.length(F.bin("n"))).count().collect())  # at most 64 rows
    e, held = 64, 0
    while e and held + widths.get(e, 0) <= many:
        held += widths.get(e, 0)
        e -= 1
    return short.where(F.length(F.bin("n")) > e)


# ---- the filter


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (((mix64(hashes * _SEGMENT) >> U(32)) * U(segments)) >> U(32)).astype(np.int64)


def gram_counts(docs: DataFrame, order: int, segments: int) -> DataFrame:
    """docs (text) -> segment, hashes, counts: of each batch of texts its distinct n-grams, as packed arrays by segment."""

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, n = _summed(np.concatenate(parts), None)
        seg = segment_of(h, segments)
        at = np.argsort(seg, kind="stable")
        h, n, seg = h[at], np.minimum(n[at], 2**31 - 1).astype("<i4"), seg[at]
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        ends = [*first[1:].tolist(), len(seg)]
        slices = [slice(a, b) for a, b in zip(first.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(seg[first].astype(np.int32)), pa.array([h[s].tobytes() for s in slices], pa.binary()), pa.array([n[s].tobytes() for s in slices], pa.binary())],
            ["segment", "hashes", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, data, starts, stops, rows in _texts(batches, 0):
            g = grams(data, starts, stops, rows, order)
            held += [h[g.place >= max(k, 1)] for k, h in enumerate(g.hashes)]
            size += len(g.hashes[0])
            if size >= COUNTED:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)
        release_memory()

    return docs.select("text").mapInArrow(run, "segment int, hashes binary, counts binary")


def _summed(hashes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes with the sum of their counts, or with their number."""
    if counts is None:
        return np.unique(hashes, return_counts=True)
    at = np.argsort(hashes)
    hashes, counts = hashes[at], counts[at]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(hashes) else counts


def _places(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the bits of the keys (n-gram, level) begin and how far they are apart, for _place()."""
    x = mix64(hashes + U(level * _STEP % (1 << 64)))
    return x, mix64(x) | U(1)


def _place(x: np.ndarray, step: np.ndarray, k: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """The k-th bit of each key in segments of so many bits, fewer than 2^32."""
    return (((x + U(k) * step) >> U(32)) * size) >> U(32)


def _bits(h: np.ndarray, n: np.ndarray, shape: Shape) -> bytes:
    """The segment of these n-grams, with their counts."""
    levels = shape.levels(n)
    size = max(64, -(-int(levels.sum()) * shape.bits // 8) * 8)
    bits = np.zeros(size, dtype=np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        h, levels = h[levels >= level], levels[levels >= level]
        x, step = _places(h, level)
        for k in range(shape.hashes):
            bits[_place(x, step, k, U(size))] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def build(counts: DataFrame, shape: Shape) -> DataFrame:
    """What gram_counts() returns -> segment, bits: the filter, a row for each segment that has keys."""

    def run(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = [], []
        for t in tables:
            h += [np.frombuffer(x.as_buffer(), dtype=U) for x in t.column("hashes")]
            n += [np.frombuffer(x.as_buffer(), dtype="<i4") for x in t.column("counts")]
        out = _bits(*_summed(np.concatenate(h), np.concatenate(n).astype(np.int64)), shape)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out], pa.binary())], ["segment", "bits"])

    return counts.groupBy("segment").applyInArrow(run, "segment int, bits binary")


class Filter:
    """Segments side by side in one buffer; level() probes them."""

    def __init__(self, parts: dict[int, bytes], segments: int, shape: Shape):
        sizes = np.zeros(segments, dtype=np.int64)
        for i, b in parts.items():
            sizes[i] = 8 * len(b)
        self.sizes, self.first, self.shape = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]), shape
        self.data = b"".join(parts[i] for i in sorted(parts))

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it is in none, by probing levels from 1 until one is missing."""
        data, found = np.frombuffer(self.data, dtype=np.uint8), np.zeros(len(hashes), dtype=np.int64)
        seg = segment_of(hashes, len(self.sizes))
        first, size = self.first[seg], self.sizes[seg].astype(U)
        at, level = np.flatnonzero(size > 0), 0
        while len(at):
            level += 1
            begin, bits, left = first[at], size[at], np.arange(len(at))
            x, step = _places(hashes[at], level)
            there = np.ones(len(at), dtype=bool)
            for k in range(self.shape.hashes):
                place = begin + _place(x, step, k, bits).astype(np.int64)
                there &= (data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                if k in (0, 2):  # most of what is missing is told by one bit, and most of the rest by three
                    x, step, begin, bits, left = x[there], step[there], begin[there], bits[there], left[there]
                    there = np.ones(len(left), dtype=bool)
            at = at[left[there]]
            found[at] = level
        return found


# ---- scores

#: n-gram hashes -> levels.
Lookup = Callable[[np.ndarray], np.ndarray]


def log_probabilities(g: Grams, unigrams: np.ndarray, lookup: Lookup, shape: Shape, tokens: int, distinct: int) -> np.ndarray:
    """log10 of each token's probability; unigrams: the filter's count of each entry. Each n-gram of the texts is looked up once.

    The history of an n-gram is the one, shorter by one, that ends at the entry before.
    """
    p, before = (unigrams + 0.1) / (tokens + 0.1 * (distinct + 1)), unigrams
    for k in range(1, shape.order):
        has = g.place >= k
        wanted, number = np.unique(g.hashes[k][has], return_inverse=True)
        counts = np.zeros(len(p))
        counts[has] = seen = shape.estimates()[lookup(wanted)][number]
        history = np.concatenate([[0.0], before[:-1]])[has]
        p[has] = (np.minimum(seen, history) + shape.mu * p[has]) / (history + shape.mu)
        before = counts
    return np.log10(p[g.place > 0])


@dataclass
class Model:
    """What train() learns: exact counts, a filter as a table and, if it is small, as a broadcast."""

    shape: Shape
    tokens: int
    distinct: int
    segments: int
    counts: DataFrame
    bits: DataFrame
    filter: Broadcast | None
    head: Broadcast

    def discard(self) -> None:
        discard(self.counts, self.bits)


def train(docs: DataFrame, shape: Shape = Shape(), *, filter_bytes: int = FILTER_BYTES, segment_tokens: int = SEGMENT_TOKENS) -> Model:
    """docs (text), all of which are learned from."""
    spark = docs.sparkSession
    counts = materialise(word_counts(docs), "words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    segments = max(1, -(-totals["tokens"] * shape.order // segment_tokens))
    bits = materialise(build(gram_counts(docs, shape.order, segments), shape), "filter")
    short = head_words(counts).collect()
    head = spark.sparkContext.broadcast(([bytes(r["word"]) for r in short], [r["n"] for r in short]))
    size = bits.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    made = None
    if size <= filter_bytes:
        made = spark.sparkContext.broadcast(Filter({r["segment"]: bytes(r["bits"]) for r in bits.toLocalIterator()}, segments, shape))
    return Model(shape, totals["tokens"], totals["distinct"], segments, counts, bits, made, head)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows (doc_id, text[, hashes, levels]) -> doc_id, n_tokens, n_known, base, score, rest: the words that HEAD has not, with their numbers.

    With hashes and levels, the levels of a text's n-grams that are in the filter, those are used; otherwise the broadcast filter is.
    """
    shape, tokens, distinct, filtered, head = model.shape, model.tokens, model.distinct, model.filter, model.head
    total = np.log10(tokens + 0.1 * (distinct + 1))

    def own(batch: pa.RecordBatch, first: int, many: int) -> Lookup:
        hashes, levels = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(x.values) for x in batch.column(i).slice(first, many) if x.is_valid)]) for i in (2, 3))
        keys, at = np.unique(hashes.view(U), return_index=True)
        levels = levels[at]

        def lookup(wanted: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(wanted), dtype=np.int64)
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[place] == wanted, levels[place], 0)

        return lookup

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = pa.array(head.value[0], pa.binary()), np.array(head.value[1], dtype=np.int64)
        cached = None if filtered is None or not len(names) else filtered.value.level(_hashes_of(head.value[0]))  # once a task
        for batch, first, data, starts, stops, rows in _texts(batches, 1):
            many = len(rows) - 1
            g = grams(data, starts, stops, rows, shape.order)
            lookup = own(batch, first, many) if filtered is None else filtered.value.level
            row = np.repeat(np.arange(many), np.diff(rows))
            found, first_at, number = _distinct_words(data, starts, stops)
            # END is a word of each text, the last one of the chunk's list.
            found = pa.concat_arrays([found.cast(pa.binary()), pa.array([END], pa.binary())])
            place = pc.index_in(found, value_set=names)
            known, head_at = np.asarray(place.is_valid()), np.asarray(place.fill_null(0))
            hashes = np.concatenate([g.hashes[0][g.at[first_at]], g.hashes[0][:1]])
            levels = np.where(known, cached[head_at], 0) if cached is not None else np.zeros(len(found), dtype=np.int64)
            probed = ~known if cached is not None else slice(None)
            levels[probed] = lookup(hashes[probed])
            counts = shape.estimates()[levels]
            unigrams = np.full(len(g.place), counts[-1])
            unigrams[g.at] = counts[number]
            logs = np.add.reduceat(log_probabilities(g, unigrams, lookup, shape, tokens, distinct), g.rows[:-1])  # no text is without tokens
            count = np.where(known, numbers[head_at] if len(numbers) else 0, 0)
            row, number = np.concatenate([row, np.arange(many)]), np.concatenate([number, np.full(many, len(found) - 1)])
            base = np.bincount(row, weights=np.where(known[number], np.log10(count[number] + 0.1) - total, 0.0), minlength=many)
            held = np.bincount(row[known[number]], minlength=many)
            away = ~known[number]
            pair, n = np.unique(row[away] * len(found) + number[away], return_counts=True)
            offsets = np.searchsorted(pair, np.arange(many + 1) * len(found)).astype(np.int32)
            rest = pa.StructArray.from_arrays([found.take(pa.array(pair % len(found))), pa.array(n, pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, many), pa.array(np.diff(g.rows), pa.int64()), pa.array(held, pa.int64()), pa.array(base),
                    pa.array(logs), pa.ListArray.from_arrays(pa.array(offsets), rest),
                ],
                ["doc_id", "n_tokens", "n_known", "base", "score", "rest"],
            )
        release_memory()

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,n:long>>")


def _with_levels(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text, hashes, levels, where the filter is too large to be broadcast: each distinct n-gram of a chunk
    is sent to its segment once, and levels come back in the order in which they were asked for."""
    order, segments, shape = model.shape.order, model.segments, model.shape
    dealt = _dealt(docs.select("doc_id", "text", F.lit(False).alias("trains")))

    def distinct(pieces: list[Grams]) -> tuple[np.ndarray, np.ndarray]:
        """By segment; the segments."""
        h = np.unique(np.concatenate([x[g.place >= k] for g in pieces for k, x in enumerate(g.hashes)]))
        seg = segment_of(h, segments)
        at = np.argsort(seg, kind="stable")
        return h[at], seg[at]

    def ask(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, seg = distinct([grams(*x[2:], order) for x in _texts(batches, 1)])
        first = _firsts(seg)
        sent = [x.tobytes() for x in np.split(h, first[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(first), pa.int64()), pa.array(seg[first].astype(np.int32)), pa.array(sent, pa.binary())], ["chunk", "segment", "hashes"])
        release_memory()

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        only = Filter({0: right.column("bits")[0].as_py()} if len(right) else {}, 1, shape)
        found = [only.level(np.frombuffer(x, U)).astype(np.uint8).tobytes() if len(right) else bytes(len(x) // 8) for x in left.column("hashes").to_pylist()]
        return pa.table([left.column("chunk"), left.column("segment"), pa.array(found, pa.binary())], ["chunk", "segment", "levels"])

    def give(texts: pa.Table, found: pa.Table) -> pa.Table:
        pieces = [(x[0], x[1], grams(*x[2:], order)) for x in _texts(iter(texts.combine_chunks().to_batches()), 1)]
        h, _ = distinct([g for _, _, g in pieces])
        rows = sorted(zip(found.column("segment").to_pylist(), found.column("levels").to_pylist(), strict=True))
        levels = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).astype(np.int64)
        at = np.argsort(h)
        h, levels, out = h[at], levels[at], []
        for batch, first, g in pieces:
            many = len(g.rows) - 1
            text = np.repeat(np.arange(many), np.diff(g.rows) + 1)
            text = np.concatenate([text[g.place >= k] for k in range(order)])
            place = np.searchsorted(h, np.concatenate([x[g.place >= k] for k, x in enumerate(g.hashes)]))
            pair = np.unique(text * len(h) + place)
            text, place = pair // len(h), pair % len(h)
            some = levels[place] > 0
            ends = pa.array(np.searchsorted(text[some], np.arange(many + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[place[some]])) for x in (h.view(np.int64), levels)]
            out.append(pa.table([*(batch.column(i).slice(first, many) for i in (0, 1)), *lists], ["doc_id", "text", "hashes", "levels"]))
        return pa.concat_tables(out)

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk long, segment int, hashes binary")
    levels = asked.groupBy("segment").cogroup(model.bits.groupBy("segment")).applyInArrow(probe, "chunk long, segment int, levels binary")
    return dealt.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(give, "doc_id long, text string, hashes array<long>, levels array<long>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, n_known, base_score, score."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = _scored(slim if model.filter is not None else _with_levels(slim, model), model)
    made = materialise(made.withColumn("key", F.monotonically_increasing_id()), "scored")
    rest = made.select("key", F.explode("rest").alias("x")).select("key", "x.word", F.col("x.n").alias("times"))
    seen = rest.join(model.counts, "word", "left")
    total = F.lit(float(np.log10(model.tokens + 0.1 * (model.distinct + 1))))
    sums = seen.groupBy("key").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.1) - total)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
    )
    done = made.drop("rest").join(sums, "key", "left")
    return done.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


# ---- learning and scoring at once


def _dealt(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, trains) stored with `chunk`, dealt by it, so that reading it by chunk takes no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            each = np.asarray(pc.binary_length(batch.column(1)).fill_null(0)).astype(np.int64)
            before = size + np.cumsum(each) - each
            size += int(each.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(each), pa.array(task + before // DEALT_BYTES)], ["doc_id", "text", "trains", "size", "chunk"])

    cut = docs.mapInArrow(run, "doc_id long, text string, trains boolean, size long, chunk long")
    return materialise_sorted(cut, "chunks", ("chunk",), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), compression="zstd")


def _small(n: np.ndarray) -> bytes:
    """Numbers that are mostly small: a byte each, and those beyond it after all bytes."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def _numbers(data: bytes, many: int) -> np.ndarray:
    """What _small() has made of so many."""
    n = np.frombuffer(data, np.uint8, many).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<i8", offset=many)
    return n


def _firsts(x: np.ndarray) -> np.ndarray:
    """The places of sorted numbers where another one begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def _lengths(words: pa.Array) -> np.ndarray:
    return np.asarray(pc.binary_length(words)).astype(np.int64)


def _bytes_of(words: pa.Array) -> np.ndarray:
    """The bytes of all words of a large_binary array, one after the other."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64, len(words) + 1 + words.offset)[words.offset :]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


class _Chunk:
    """The distinct n-grams of the texts of a chunk, in an order that does not depend on that of its rows.

    keys: those of two words or more, a segment's number before the hash in it; words: the distinct words, END first, dealt to segments.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], order: int, segments: int):
        self.segments, self.pieces, found, hashes = segments, [], [pa.array([END], pa.large_binary())], [np.zeros(0, U)]
        for batch, first, data, starts, stops, rows in _texts(batches, 1):
            g = grams(data, starts, stops, rows, order)
            own, first_at, number = _distinct_words(data, starts, stops)
            found.append(own)
            self.pieces.append((batch.slice(first, len(rows) - 1), g, rows, number))
            hashes.append(g.hashes[0][g.at[first_at]])
        coded = pa.concat_arrays(found).dictionary_encode()
        self.words, index = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        #: Of each piece, the places of its distinct words among those of the chunk.
        self.index = np.split(index, np.cumsum([len(x) for x in found]))[1:-1]
        self.hash = np.empty(len(self.words), U)
        self.hash[index] = np.concatenate([_hashes_of([END]), *hashes])
        self.segment = segment_of(self.hash, segments)
        self.order = np.lexsort((self.hash, self.segment))
        if (np.diff(self.hash[self.order]) == 0).any():  # words that hash alike go by themselves
            names = self.words.to_pylist()
            self.order = np.array(sorted(range(len(names)), key=lambda i: (self.segment[i], self.hash[i], names[i])))

    def key(self, hashes: np.ndarray) -> np.ndarray:
        return (segment_of(hashes, self.segments).astype(U) << KEY_BITS) | (hashes >> (U(64) - KEY_BITS))

    def keys(self) -> np.ndarray:
        """Of all n-grams of two words and more: the key, and in the last bit whether the text is learned from."""
        out = [np.zeros(0, U)]
        for batch, g, rows, _ in self.pieces:
            trains = np.repeat(np.asarray(batch.column(2).fill_null(False)).astype(U), np.diff(rows) + 2)
            out += [(self.key(h[g.place >= k]) << U(1)) | trains[g.place >= k] for k, h in enumerate(g.hashes) if k]
        return np.sort(np.concatenate(out))

    def times(self) -> np.ndarray:
        """How often each word is in the texts that are learned from."""
        out = np.zeros(len(self.words), np.int64)
        for (batch, _, rows, number), index in zip(self.pieces, self.index, strict=True):
            trains = np.asarray(batch.column(2).fill_null(False))
            out[index] += np.bincount(number[np.repeat(trains, np.diff(rows))], minlength=len(index))
            out[0] += trains.sum()
        return out


def _asked(dealt: DataFrame, order: int, segments: int) -> DataFrame:
    """What _dealt() returns -> a row for each chunk and segment: the chunk's distinct n-grams there and how often each is learned from."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(batches, order, segments)
        keys = chunk.keys()
        first = _firsts(keys >> U(1))
        n = np.add.reduceat((keys & U(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        keys = keys[first] >> U(1)
        times, size, words = chunk.times()[chunk.order], _lengths(chunk.words)[chunk.order], _bytes_of(chunk.words.take(pa.array(chunk.order)))
        marks = np.arange(segments + 1)
        at, word_at = np.searchsorted(keys, marks.astype(U) << KEY_BITS), np.searchsorted(chunk.segment[chunk.order], marks)
        byte_at = np.concatenate([[0], np.cumsum(size)])[word_at]
        out = []
        for s in np.flatnonzero((np.diff(at) > 0) | (np.diff(word_at) > 0)).tolist():
            k, w = slice(at[s], at[s + 1]), slice(word_at[s], word_at[s + 1])
            high, low = (keys[k] >> U(32)).astype(np.uint8), keys[k].astype("<u4")
            out.append((s, high.tobytes() + low.tobytes(), _small(n[k]), words[byte_at[s] : byte_at[s + 1]].tobytes(), _small(size[w]), _small(times[w]), len(size[w])))
        kinds = [pa.int32(), *[pa.binary()] * 5, pa.int32()]
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(out), pa.int64()), *columns], ["chunk", "segment", "keys", "counts", "words", "sizes", "times", "n_words"])
        release_memory()

    return dealt.groupBy("chunk").applyInArrow(run, "chunk long, segment int, keys binary, counts binary, words binary, sizes binary, times binary, n_words int")


def _answered(asked: DataFrame, shape: Shape) -> DataFrame:
    """What _asked() returns -> for each of its rows the levels of n-grams and words, read from the segment's part of the filter, and
    the exact counts of words; tokens and distinct words of a segment stand in one of its rows."""

    def run(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, keys, counts, words, sizes, times = [], [], [], [], [], []
        for t in tables:
            chunk += t.column("chunk").to_pylist()
            for k, n, w, size, time, many in zip(*(t.column(c).to_pylist() for c in ("keys", "counts", "words", "sizes", "times", "n_words")), strict=True):
                grams = len(k) // 5
                keys.append((np.frombuffer(k, np.uint8, grams).astype(U) << U(32)) | np.frombuffer(k, "<u4", offset=grams))
                counts.append(_numbers(n, grams))
                words.append(w)
                sizes.append(_numbers(size, many))
                times.append(_numbers(time, many))
        ends, word_ends = np.cumsum([len(x) for x in keys])[:-1], np.cumsum([len(x) for x in sizes])[:-1]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(words))]).dictionary_encode()
        word = np.asarray(coded.indices).astype(np.int64)
        n_word = np.bincount(word, np.concatenate(times), len(coded.dictionary)).astype(np.int64)
        own, gram = np.unique(np.concatenate(keys), return_inverse=True)
        n_gram = np.bincount(gram, np.concatenate(counts), len(own)).astype(np.int64)
        h = np.concatenate([mix64(own), _hashes_of(coded.dictionary.to_pylist())])
        n = np.concatenate([n_gram, n_word])
        levels = Filter({0: _bits(h[n > 0], n[n > 0], shape)}, 1, shape).level(h).astype(np.uint8)
        levels[len(own) :][n_word == 0] = 0  # a word's exact count is known here
        of_gram, of_word = np.split(levels[: len(own)][gram], ends), np.split(levels[len(own) :][word], word_ends)
        once = [1] + [0] * (len(chunk) - 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(chunk, pa.int64()), pa.array([key[0].as_py()] * len(chunk), pa.int32()), pa.array([x.tobytes() for x in of_gram], pa.binary()),
                pa.array([x.tobytes() for x in of_word], pa.binary()), pa.array([_small(x) for x in np.split(n_word[word], word_ends)], pa.binary()),
                pa.array([int(n_word.sum()) * x for x in once], pa.int64()), pa.array([int((n_word > 0).sum()) * x for x in once], pa.int64()),
            ],
            ["chunk", "segment", "levels", "word_levels", "word_counts", "tokens", "distinct"],
        )
        release_memory()

    return asked.groupBy("segment").applyInArrow(run, "chunk long, segment int, levels binary, word_levels binary, word_counts binary, tokens long, distinct long")


def fitted_scores(docs: DataFrame, trains: Column, shape: Shape = Shape(), *, segment_tokens: int = SEGMENT_TOKENS) -> tuple[DataFrame, int]:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, n_known, base_score, score of all rows, by what those where `trains` holds teach; and their tokens."""
    dealt = _dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", trains.alias("trains")))
    size = dealt.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # A token takes two bytes or more, about six in prose.
    segments = max(1, -(-(size[0] // 6 + size[1]) * shape.order // segment_tokens))
    answers = materialise(_answered(_asked(dealt, shape.order, segments), shape), "levels", compression="zstd")
    tokens, distinct = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("distinct")).first())
    total = np.log10(tokens + 0.1 * (distinct + 1))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        chunk = _Chunk(iter(texts.combine_chunks().to_batches()), shape.order, segments)
        keys = chunk.keys() >> U(1)
        keys = keys[_firsts(keys)]
        rows = sorted(zip(*(found.column(c).to_pylist() for c in ("segment", "levels", "word_levels", "word_counts")), strict=True))
        levels = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).astype(np.int64)
        word_levels, counts = np.empty(len(chunk.words), np.int64), np.empty(len(chunk.words), np.int64)
        word_levels[chunk.order] = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        counts[chunk.order] = np.concatenate([_numbers(r[3], len(r[2])) for r in rows])
        estimates, logs = shape.estimates()[word_levels], np.log10(counts + 0.1) - total
        out = []
        for (batch, g, rows, number), index in zip(chunk.pieces, chunk.index, strict=True):
            many, number = len(rows) - 1, index[number]
            unigrams = np.full(len(g.place), estimates[0])
            unigrams[g.at] = estimates[number]
            score = log_probabilities(g, unigrams, lambda h: levels[np.searchsorted(keys, chunk.key(h))], shape, tokens, distinct)
            row = np.repeat(np.arange(many), np.diff(rows))
            base = np.bincount(row, logs[number], many) + logs[0]
            known = np.bincount(row, counts[number] > 0, many).astype(np.int64) + int(counts[0] > 0)
            out.append(pa.table([batch.column(0), pa.array(np.diff(g.rows)), pa.array(known), pa.array(base), pa.array(np.add.reduceat(score, g.rows[:-1]))], ["doc_id", "n_tokens", "n_known", "base_score", "score"]))
        release_memory()
        return pa.concat_tables(out)

    by_chunk = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return by_chunk.applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double"), tokens
