"""Toxicity by a linear-chain conditional random field over words.

Labels. Only documents are labelled, so words get labels first: every word of
a clean document is clean, and a word of a toxic document is toxic if one of its
features (itself or a prefix) is many times as frequent in toxic documents as in
clean ones, and a likelihood-ratio test rejects chance after correction for the number of features.

Model. Two states; a word's state score is the sum of the weights of its
features, and neighbours interact through a 2 x 2 table. It is fitted by
gradient ascent, the gradient being labels minus forward-backward marginals.
A document is one chain, however long. With two states the recursions are on
odds alone; they run over all documents of a batch at once, in pieces of PIECE
words: what a piece makes of the odds that come in is a 2 x 2 matrix, so the
odds at the ends of all pieces of a document follow by products, and the
marginals are those of the whole chain.

Scores. A document's largest marginal and its expected number of toxic words, among those more likely so than not,
enter a logistic function fitted on the same sample. Words with a marginal of
a half or more are the offending spans, neighbours merged.

The fit reads a bounded sample: at most `sample` documents of either label, in hash order, one text of
each, whole. That is its only bound. All their words train the field, but for toxic documents without any
word labelled toxic, whose word labels are unknown; these enter the logistic function alone. A feature has a weight if
the sample shows it three times. Scoring reads everything.

Defined results:
 - null or empty text, or without words: the score of no evidence, no spans;
 - null doc_id: scored like any row, never learned from; repeated rows: each by its own text, the smallest is learned from;
 - several labels of a document: toxic if any is; null labels do not count;
 - no labels of one kind: the score is the share of toxic labels, 0 without labels;
 - very long texts: whole; an empty table gives an empty result; no column but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm import textvec

U = np.uint64
#: Words that the recursions take one after another; longer documents are linked from pieces.
PIECE = 512
PREFIXES = (4, 5, 6)
#: Toxic words are rare: the score of a word of which no feature is known.
OFFSET = -4.0
#: A feature that marks toxic words is so many times as frequent in toxic documents as in clean ones.
SEED_RATIO = 10.0
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[128:] = False
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


@dataclass
class Model:
    known: np.ndarray  # hashes of the features that have a weight, ascending
    weights: np.ndarray
    moves: np.ndarray  # potentials of staying clean, turning toxic, turning clean, staying toxic
    logit: np.ndarray  # intercept, weight of the largest marginal, weight of log(1 + expected count)

    def table(self) -> Table:
        return Table(self.known, self.weights)


class Table:
    """Weights by feature hash. The leading bits of a hash lead to the few features that share them, and these are compared in full."""

    def __init__(self, known: np.ndarray, weights: np.ndarray):
        bits = min(24, max(8, len(known).bit_length() + 3))
        self.known, self.weights, self.shift = known, weights, U(64 - bits)
        self.first = np.searchsorted(known >> self.shift, np.arange((1 << bits) + 1, dtype=U)).astype(np.uint32)

    def weight(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        ask = np.flatnonzero(at < end)
        at, end = at[ask], end[ask]
        while len(ask):
            hit = self.known[at] == h[ask]
            out[ask[hit]] = self.weights[at[hit]]
            on = ~hit & (at + 1 < end)
            ask, at, end = ask[on], at[on] + 1, end[on]
        return out


def word_scores(f: list[np.ndarray], table: Table) -> np.ndarray:
    """The sum of the weights of each word's known features, and the offset that every word has."""
    out = np.full(len(f[0]), OFFSET)
    for column in f:
        out += table.weight(column)
    return out


def features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word's features, a kind after another: the word and its prefixes; a word that is shorter repeats itself."""
    data = textvec.folded(data)
    return [textvec.span_hashes(data, starts, stops if n is None else np.minimum(starts + n, stops), n or 0) for n in (None, *PREFIXES)]


def _pieces(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word offsets of rows -> first word, length, number in its row and number of pieces of the row, for each piece."""
    sizes = np.diff(rows)
    many = -(-sizes // PIECE)
    order = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first = np.repeat(rows[:-1], many) + PIECE * order
    return first, np.minimum(PIECE, np.repeat(rows[1:], many) - first), order, np.repeat(many, many)


def _run(own: np.ndarray, ends: np.ndarray, step: int, size: np.ndarray, value: np.ndarray, moves: tuple, out: np.ndarray) -> np.ndarray:
    """Carry odds through pieces. ends: their first words in the direction of step; value: the odds there. The odds times the
    word's own go to out, forward; what comes out at the far ends is returned."""
    base, into, leave, stay = moves
    by = np.argsort(-size, kind="stable")
    size, at, held = size[by], ends[by], value[by]
    final = np.empty(len(by))
    out[at] = held
    t = 0
    while len(held):
        more = int(np.searchsorted(-size, -(t + 1), side="left"))  # pieces that go on
        final[by[more : len(held)]] = held[more:]
        held = held[:more]
        t += 1
        where = at[:more] + step * t
        held = own[where] * (into + stay * held) / (base + leave * held)
        out[where] = held
    return final


def _transfer(own: np.ndarray, ends: np.ndarray, step: int, moves: tuple) -> np.ndarray:
    """For whole pieces, the matrix that takes the odds before the piece to those at its far end."""
    base, into, leave, stay = moves
    m = np.zeros((len(ends), 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = 1.0
    for t in range(PIECE):
        e = own[ends + step * t]
        top, low = m[:, 0].copy(), m[:, 1].copy()
        m[:, 0] = e[:, None] * (stay * top + into * low)
        m[:, 1] = leave * top + base * low
        m /= m.max(axis=(1, 2))[:, None, None]
    return m


def _carry(own: np.ndarray, rows: np.ndarray, step: int, moves: tuple) -> np.ndarray:
    """own times the odds that come to each word from the words before it, in the direction of step; own alone at the start of a row."""
    base, into, leave, stay = moves
    out = np.empty(len(own))
    first, size, order, many = _pieces(rows)
    ends = first if step > 0 else first + size - 1
    turn = order if step > 0 else many - 1 - order
    start = turn == 0
    far = np.zeros(len(first))
    far[start] = _run(own, ends[start], step, size[start], own[ends[start]], moves, out)
    rest = np.flatnonzero(~start)
    if not len(rest):
        return out
    inner = np.flatnonzero(~start & (turn < many - 1))
    matrix = np.zeros((len(first), 2, 2))
    matrix[inner] = _transfer(own, ends[inner], step, moves)
    come = np.zeros(len(first))
    by_turn = rest[np.argsort(turn[rest], kind="stable")]
    bounds = np.searchsorted(turn[by_turn], np.arange(1, turn.max() + 2))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        here = by_turn[a:b]
        odds = far[here - step]
        come[here] = odds
        m = matrix[here]
        with np.errstate(divide="ignore", invalid="ignore"):  # the last piece of a row has no matrix and needs none
            far[here] = (m[:, 0, 0] * odds + m[:, 0, 1]) / (m[:, 1, 0] * odds + m[:, 1, 1])
    value = own[ends[rest]] * (into + stay * come[rest]) / (base + leave * come[rest])
    _run(own, ends[rest], step, size[rest], value, moves, out)
    return out


def odds(scores: np.ndarray, rows: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its own odds, own times those from before it, own times those from behind it; each row is one chain."""
    own = np.exp(np.clip(scores, -30, 30))
    stay0, to1, to0, stay1 = moves
    ahead = _carry(own, rows, 1, (stay0, to1, to0, stay1))
    behind = _carry(own, rows, -1, (stay0, to0, to1, stay1))
    return own, ahead, behind


def marginals(scores: np.ndarray, rows: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The probability that each word is toxic."""
    own, ahead, behind = odds(scores, rows, moves)
    both = ahead * behind / own
    return both / (1 + both)


def summaries(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Largest marginal and log(1 + expected toxic words) of each row; the sum is over words that are toxic rather than not, so length adds nothing."""
    out = np.zeros((len(rows) - 1, 2))
    some = np.flatnonzero(np.diff(rows))
    if len(some):
        out[some, 0] = np.maximum.reduceat(p, rows[some])
        out[some, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.5, p, 0.0), rows[some]))
    return out


def seed_labels(f: list[np.ndarray], rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for the words of toxic rows with a feature that toxic rows hold beyond chance, else 0.

    A feature counts once after each distinct preceding word, so copies of a passage add no evidence.
    """
    bad = np.repeat(toxic, np.diff(rows)) > 0
    before = np.concatenate([np.zeros(1, dtype=U), f[0][:-1]])
    before[rows[:-1][np.diff(rows) > 0]] = 0
    label = np.zeros(len(f[0]), dtype=np.int8)
    for column in f:
        names, number = np.unique(column, return_inverse=True)
        context = textvec.mix64(column + before * U(0xD6E8FEB86659FD93))
        counts = []
        for kind in (bad, ~bad):
            _, at = np.unique(context[kind], return_index=True)
            counts.append(np.bincount(number[kind][at], minlength=len(names)))
        in_toxic, in_clean = counts
        share = in_toxic.sum() / (in_toxic.sum() + in_clean.sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(in_toxic > 0, in_toxic * np.log(in_toxic / ((in_toxic + in_clean) * share)), 0)
            gain += np.where(in_clean > 0, in_clean * np.log(in_clean / ((in_toxic + in_clean) * (1 - share))), 0)
        ratio = (in_toxic + 0.5) / (in_clean + 0.5) * (1 - share) / share
        beyond = (ratio >= SEED_RATIO) & (gain > np.log(len(names)) + 3)
        label |= beyond[number].astype(np.int8)
    return label * bad.astype(np.int8)


def _parts(chain: np.ndarray, words: int = 1 << 19) -> list[tuple[int, int]]:
    """Runs of chains of about so many words, by their first and last bounds."""
    cuts = np.unique(np.searchsorted(chain, np.arange(0, chain[-1], words)))
    cuts = np.unique(np.concatenate([[0], cuts, [len(chain) - 1]]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _add_gradient(
    label: np.ndarray, number: list[np.ndarray], chain: np.ndarray, w: np.ndarray, moves: np.ndarray, grad: np.ndarray, g_theta: np.ndarray
) -> None:
    """Add labels minus marginals of some chains, by feature and by kind of step."""
    lo, hi = int(chain[0]), int(chain[-1])
    columns, y = [c[lo:hi] for c in number], label[lo:hi].astype(float)
    scores = np.full(hi - lo, OFFSET)
    for c in columns:
        scores += w[c]
    own, ahead, behind = odds(scores, chain - lo, moves)
    both = ahead * behind / own
    miss = y - both / (1 + both)
    for c in columns:
        grad += np.bincount(c, weights=miss, minlength=len(w))
    pair = np.ones(max(hi - lo - 1, 0))  # 0 where a chain ends
    pair[chain[1:-1] - lo - 1] = 0.0
    r, x, a, b = ahead[:-1], behind[1:], y[:-1], y[1:]
    total = moves[0] + moves[1] * x + moves[2] * r + moves[3] * r * x
    seen = (((1 - a) * b) @ pair, (a * (1 - b)) @ pair, (a * b) @ pair)
    g_theta += np.array(seen) - np.array([(moves[1] * x / total) @ pair, (moves[2] * r / total) @ pair, (moves[3] * r * x / total) @ pair])


def fit(texts: pa.Array, toxic: np.ndarray, steps: int = 60) -> Model:
    model = Model(np.zeros(0, dtype=U), np.zeros(0, dtype=np.float32), np.ones(4), np.zeros(3))
    n, n1 = len(toxic), int(toxic.sum())
    if n1 in (0, n):
        model.logit[0] = 40.0 if n1 else -800.0
        return model
    parts, bounds = [], [np.zeros(1, dtype=np.int64)]
    for _, data, offsets in textvec.chunks(texts):
        starts, stops, rows = textvec.words(data, offsets, SEPARATOR)
        parts.append(features(data, starts, stops))
        bounds.append(rows[1:] + bounds[-1][-1])
    f, rows = [], np.concatenate(bounds)
    for i in range(1 + len(PREFIXES)):
        f.append(np.concatenate([p[i] for p in parts]))
        for p in parts:
            p[i] = None
    del parts
    label = seed_labels(f, rows, toxic)

    # The rows whose words have labels.
    sizes = np.diff(rows)
    some = np.flatnonzero(sizes)
    seeds = np.zeros(n, dtype=np.int64)
    seeds[some] = np.add.reduceat(label.astype(np.int64), rows[some]) if len(some) else 0
    use = (sizes > 0) & ((toxic == 0) | (seeds > 0))
    words = np.repeat(use, sizes)
    y, chain = label[words], np.concatenate([[0], np.cumsum(sizes[use])])
    known, number = [], []
    for i in range(len(f)):
        names, at, times = np.unique(f[i][words], return_inverse=True, return_counts=True)
        frequent = times >= 3  # what is rarer says nothing that carries over
        place = np.where(frequent, np.cumsum(frequent) + sum(map(len, known)), 0)  # 0 is the feature without weight
        known.append(names[frequent])
        number.append(place.astype(np.int32)[at])
        f[i] = None  # the features are made again where they are scored
    known = np.concatenate(known)
    del names, at, times, frequent, place, label, words

    w, theta = np.zeros(len(known) + 1), np.zeros(3)  # theta: log potentials relative to staying clean
    state = [np.zeros(len(w)), np.zeros(len(w)), np.zeros(3), np.zeros(3)]
    scale = 64 / max(len(y), 1)
    parts = _parts(chain)
    for step in range(1, steps + 1):
        moves = np.exp(np.array([0.0, *theta]))
        grad, g_theta = np.zeros(len(w)), np.zeros(3)
        for first, last in parts:
            _add_gradient(y, number, chain[first : last + 1], w, moves, grad, g_theta)
        grad = grad * scale - 1e-5 * w
        grad[0] = 0.0
        g_theta = g_theta * scale - 1e-3 * theta
        for value, g, m1, m2, rate in ((w, grad, state[0], state[1], 0.15), (theta, g_theta, state[2], state[3], 0.1)):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            value += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    order = np.argsort(known, kind="stable")
    model.known, model.weights = known[order], w[1:][order].astype(np.float32)
    model.moves = np.exp(np.array([0.0, *theta]))
    del y, number, state

    table = model.table()
    found = []
    for _, data, offsets in textvec.chunks(texts):
        starts, stops, some = textvec.words(data, offsets, SEPARATOR)
        found.append(summaries(marginals(word_scores(features(data, starts, stops), table), some, model.moves), some))
    x = np.column_stack([np.ones(n), np.concatenate(found)])
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        beta = beta + np.linalg.solve(hess, x.T @ (toxic - q) - 1e-2 * beta)
    model.logit = beta
    return model


def score_batch(texts: pa.Array, model: Model, table: Table) -> Iterator[tuple[int, np.ndarray, list[list[dict]]]]:
    """First row, scores, spans of each chunk of texts."""
    for first, data, offsets in textvec.chunks(texts):
        starts, stops, rows = textvec.words(data, offsets, SEPARATOR)
        p = marginals(word_scores(features(data, starts, stops), table), rows, model.moves)
        x = np.column_stack([np.ones(len(rows) - 1), summaries(p, rows)]) @ model.logit
        spans: list[list[dict]] = [[] for _ in range(len(rows) - 1)]
        bad = np.flatnonzero(p >= 0.5)
        if len(bad):
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            row_of = np.searchsorted(rows, bad, side="right") - 1
            for t, row in zip(bad.tolist(), row_of.tolist(), strict=True):
                base = points[offsets[row]]
                a, b = int(points[starts[t]] - base), int(points[stops[t]] - base)
                last = spans[row][-1] if spans[row] else None
                if last and last["word"] == t - 1:
                    last["end"], last["word"], last["p"] = b, t, max(last["p"], float(p[t]))
                else:
                    spans[row].append({"start": a, "end": b, "p": float(p[t]), "word": t})
        yield first, 1 / (1 + np.exp(-np.clip(x, -700, 700))), spans


def held_out(doc_id: Column) -> Column:
    """Whether a document is set aside for testing: crc32 of its id as text is a multiple of 5 (a null id counts as no text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 1500) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): fit on a bounded sample of the labelled documents that are not held out."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    kinds = [marked.where(F.col("toxic") > 0), marked.where(F.col("toxic") <= 0)]
    chosen = [k.orderBy(order, "doc_id").limit(sample) for k in kinds]
    ids = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("id"), "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))  # at most 2 * sample ids
    texts = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), (F.max("toxic") > 0).cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if len(b)]
        if found:
            table = pa.Table.from_batches(found).sort_by("doc_id").combine_chunks()
            model = fit(table["text"].combine_chunks(), np.asarray(table["toxic"]))
            del table, found
            textvec.release_memory()
        else:
            model = fit(pa.array([], pa.string()), np.zeros(0))
        data = [model.known.tobytes(), model.weights.tobytes(), model.moves.tobytes(), model.logit.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], ["known", "weights", "moves", "logit"])

    row = texts.repartition(1).mapInArrow(run, "known binary, weights binary, moves binary, logit binary").first()
    if row is None:
        return fit(pa.array([], pa.string()), np.zeros(0))
    return Model(np.frombuffer(row[0], U), np.frombuffer(row[1], np.float32), np.frombuffer(row[2]), np.frombuffer(row[3]))


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score, predicted, spans: array of (start, end, p) in code points."""
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for first, score, spans in score_batch(batch.column("text"), model, table):
                ids = batch.column("doc_id").slice(first, len(score))
                spans = pa.array([[{k: s[k] for k in ("start", "end", "p")} for s in row] for row in spans], kinds)
                predicted = pa.array((score >= 0.5).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.array(score), predicted, spans], ["doc_id", "score", "predicted", "spans"])

    schema = "doc_id long, score double, predicted int, spans array<struct<start:long,end:long,p:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model calls toxic; all columns stay as they are."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            keep = np.ones(len(batch), dtype=bool)
            for first, score, _ in score_batch(batch.column(place), model, table):
                keep[first : first + len(score)] = score < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
