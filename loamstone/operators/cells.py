"""A stored vector index in cells: exact nearest neighbours without reading all vectors.

A cell is a centre, its vectors and their greatest distance from it, the radius. The table of vectors is laid out by cell, so that a search
reads the folders of the cells it needs. Centres come from a bounded sample; every vector is in the index.

A question is answered in two rounds. First it meets some vectors of cells near to it, which bounds its k-th distance; then those cells that
may hold a nearer one by the triangle inequality, |question - centre| - radius <= bound. What is left out cannot be a neighbour, so recall is
1 whatever the centres are, and good centres only save work. Questions come in blocks, and cells that are near to each other stand on a
shelf, some megabytes each; equal vectors are compared once. Questions and vectors are each sent once and stored once in that form; the second round
is a join of blocks with the shelves that their bounds reach, which reads both from the store and sends only the best k that a
task has found, so disk grows with the vectors and not with the visits. Only centres and radii are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.functions.vectors import is_usable

#: Vectors that the centres are fitted on, at most, and bytes of all centres.
SAMPLE_ROWS, CENTRE_BYTES = 20_000, 8 << 20
#: Vectors in a part of a cell, and questions in a block, at most.
PART_ROWS, BLOCK_ROWS = 20_000, 8192
#: Bytes of the vectors of a shelf or block, and numbers in a product of questions and vectors.
SHELF_BYTES, PRODUCT = 4 << 20, 2 << 20
SHELVED = pa.schema({"middle": pa.list_(pa.float64()), "far": pa.float64(), "cells": pa.binary(), "ids": pa.binary(), "held": pa.binary()})
BLOCKS = pa.schema(
    {"block": pa.int64(), "at": pa.list_(pa.float64()), "reach": pa.float64(), "qids": pa.binary(), "number": pa.binary(), "asked": pa.binary(), "bounds": pa.binary()}
)
#: Relative slack for rounding in bounds.
SLACK = 1e-9


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k-means on a bounded sample: distinct rows to begin with, then means of the nearest rows."""
    sample = np.unique(sample, axis=0)
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]]
    for _ in range(rounds):
        nearest = _squared(sample, centres).argmin(axis=1)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dims)


def _rows(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(is_usable(F.col("vector"))).select(F.col(key).cast("long").alias(name), F.col("vector").cast("array<double>").alias("vector"))


def build(chunks: DataFrame, path: str, key: str = "id", cells: int | None = None) -> None:
    """chunks (key, vector), vectors of one length -> the index below path: vectors by cell and part, and a table of cells.

    cells: about the square root of the number of vectors, bounded by CENTRE_BYTES. Null and zero vectors are in no index, as
    no search finds them.
    """
    rows = _rows(chunks, key, "id")
    n = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(n // SAMPLE_ROWS, 1))) == 0).limit(SAMPLE_ROWS) if n else rows
    sample = np.array([r["vector"] for r in picked.select("vector").toLocalIterator()], dtype=np.float64)
    if not n:
        centres = np.zeros((0, 1))
    else:
        sample = sample if len(sample) else np.array([rows.first()["vector"]])
        most = max(1, CENTRE_BYTES // (8 * sample.shape[1]))
        centres = fit_centres(sample, min(cells or max(1, int(n**0.5)), most))
    spark = chunks.sparkSession
    shared, dims = spark.sparkContext.broadcast(centres), centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 4096):
                part = batch.slice(first, 4096)
                m = _matrix(part.column(1), dims)
                cell = _squared(m, shared.value).argmin(axis=1)
                away = np.sqrt(((m - shared.value[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away)], ["id", "vector", "cell", "away"])

    placed = rows.mapInArrow(assign, "id long, vector array<double>, cell int, away double")
    placed.write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.min("id").alias("first_id"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    middles = spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>")
    sizes.join(F.broadcast(middles), "cell").write.parquet(f"{path}/cells")
    table = placed.join(F.broadcast(spark.read.parquet(f"{path}/cells").select("cell", "parts")), "cell")
    table = table.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    table.select("cell", "part", "id", "vector").repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/vectors")


def cells_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cells")


class _Cells:
    """The table of cells in arrays: at most CENTRE_BYTES of centres."""

    def __init__(self, cells: DataFrame):
        known = cells.orderBy("cell").collect()
        self.number, self.n = np.array([r["cell"] for r in known], np.int32), np.array([r["n"] for r in known], np.int64)
        self.parts = np.array([r["parts"] for r in known], np.int64)
        self.centres, self.radius = np.array([r["centre"] for r in known], np.float64), np.array([r["radius"] for r in known])

    def least(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A bound for the distance of each question to all vectors of each of the cells at these places."""
        d, radius = np.sqrt(_squared(q, self.centres[at])), self.radius[at]
        return np.maximum(d - radius - SLACK * (1 + d + radius) - np.sqrt(SLACK * (1 + (q * q).sum(axis=1)))[:, None], 0)

    def shelves(self) -> np.ndarray:
        """The shelf of each cell: cells that are near to each other, with about SHELF_BYTES of vectors; a cell in parts has one of its own."""
        rows = _rows_in(SHELF_BYTES, self.centres.shape[1])
        middles = fit_centres(self.centres, max(1, int(2 * self.n.sum() // rows)))
        near = np.concatenate([_squared(self.centres[a : a + 1024], middles).argmin(axis=1) for a in range(0, len(self.centres), 1024)])
        shelf, last, held = np.zeros(len(near), np.int32), 0, 0
        for i in np.lexsort((self.number, near)).tolist():
            if held and (held + self.n[i] > rows or self.parts[i] > 1):
                last, held = last + 1, 0
            shelf[i], held = last, held + (rows if self.parts[i] > 1 else self.n[i])
        return shelf


def _rows_in(size: int, dims: int) -> int:
    return max(1, size // (8 * dims))


def _vectors_of(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, dims)


def _ball(m: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean of some vectors and a bound for their distance from it."""
    middle = m.mean(axis=0)
    return middle, float(np.sqrt(((m - middle) ** 2).sum(axis=1)).max() + SLACK * (1 + np.sqrt((m * m).sum(axis=1)).max()))


def _copies(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each different vector, and for each row the number of its vector."""
    whole = np.ascontiguousarray(m + 0.0).view(np.dtype((np.void, m.shape[1] * 8)))[:, 0]  # -0.0 is 0.0
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    return first, number


def _few_copies(m: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows but those that have k equal ones of smaller ids."""
    number = _copies(m)[1]
    order = np.lexsort((ids, number))
    return order[np.arange(len(order)) - np.searchsorted(number[order], number[order]) < k]


class _Best:
    """The k nearest of what each of some questions has been compared with; ties by id. limit: beyond it nothing is looked for."""

    def __init__(self, q: np.ndarray, limit: np.ndarray, k: int):
        self.q, self.k, self.limit = q, k, limit.copy()
        self.slack, self.q2 = SLACK * (1 + (q * q).sum(axis=1)), (q * q).sum(axis=1)
        self.id, self.away = np.zeros((len(q), k), np.int64), np.full((len(q), k), np.inf)

    def add(self, ids: np.ndarray, m: np.ndarray, asks: np.ndarray) -> None:
        """asks: the questions that these vectors are compared with."""
        for a in range(0, len(asks), step := max(1, PRODUCT // len(m))):
            some = asks[a : a + step]
            rough = self.q[some] @ (-2 * m.T)
            rough += (m * m).sum(axis=1)
            limit = self.limit[some] - self.q2[some] + self.slack[some]
            if len(m) > self.k:
                limit = np.minimum(limit, (rough.min(axis=1) if self.k == 1 else np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]) + self.slack[some])
            which, row = np.nonzero(rough <= limit[:, None])
            for b in range(0, len(row), 100_000):  # a question's hits may be in two of these; they are merged
                w, r = some[which[b : b + 100_000]], row[b : b + 100_000]
                self._merge(w, ids[r], ((m[r] - self.q[w]) ** 2).sum(axis=1))

    def _merge(self, which: np.ndarray, ids: np.ndarray, away: np.ndarray) -> None:
        keep = away <= self.limit[which]
        which, ids, away = which[keep], ids[keep], away[keep]
        old = np.unique(which)
        which = np.concatenate([np.repeat(old, self.k), which])
        ids, away = np.concatenate([self.id[old].ravel(), ids]), np.concatenate([self.away[old].ravel(), away])
        order = np.lexsort((ids, away, which))
        rank = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.id[which[order], rank], self.away[which[order], rank] = ids[order], away[order]
        self.limit[old] = np.minimum(self.limit[old], self.away[old, -1])


def _shelved(vectors: DataFrame, shelf_of: DataFrame, k: int, dims: int) -> DataFrame:
    """vectors of the index -> a row for each shelf and part, with its vectors by cell; of equal ones the first k ids."""

    def pack(table: pa.Table) -> pa.Table:
        cell, ids = np.asarray(table.column("cell")), np.asarray(table.column("id"))
        m = _matrix(table.column("vector").combine_chunks(), dims)
        order = _few_copies(m, ids, k)
        order = order[np.argsort(cell[order], kind="stable")]
        middle, radius = _ball(m[order])
        return pa.table({"middle": [middle.tolist()], "far": [radius], "cells": [cell[order].astype(np.int32).tobytes()], "ids": [ids[order].astype(np.int64).tobytes()], "held": [m[order].tobytes()]}, SHELVED)

    placed = vectors.join(F.broadcast(shelf_of), "cell").select("shelf", "part", "cell", "id", "vector")
    return placed.groupBy("shelf", "part").applyInArrow(pack, "middle array<double>, far double, cells binary, ids binary, held binary")


def _blocks(asked: DataFrame, vectors: DataFrame, known: _Cells, shelf: np.ndarray, k: int) -> DataFrame:
    """asked (qid, vector) -> blocks of questions of one shelf, each question with a bound for its k-th distance, from vectors of that shelf."""
    spark, dims = asked.sparkSession, known.centres.shape[1]
    shared = spark.sparkContext.broadcast((known.centres, shelf))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, shelf = shared.value
        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.slice(first, 1024)
                home = shelf[_squared(_matrix(part.column(1), dims), centres).argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home)], ["qid", "vector", "shelf"])

    homes = asked.mapInArrow(nearest, "qid long, vector array<double>, shelf int")
    asks = dict(homes.groupBy("shelf").count().collect())  # at most as many as there are centres
    held, rows = np.bincount(shelf, known.n).astype(np.int64), _rows_in(SHELF_BYTES, dims)
    of = lambda s: (s, -(-asks[s] // min(BLOCK_ROWS, rows)), -(-int(held[s]) // max(rows, 8 * k)))
    plan = F.broadcast(spark.createDataFrame([of(s) for s in sorted(asks)], "shelf int, blocks int, nth int"))
    left = homes.join(plan, "shelf").select("shelf", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("block"), "qid", "vector")
    cells = spark.createDataFrame([(int(c), int(s)) for c, s in zip(known.number, shelf, strict=True)], "cell int, shelf int")
    # Cells of shelves that nobody asks for are not read: their folders are pruned.
    right = vectors.where(F.col("cell").isin(known.number[np.isin(shelf, list(asks))].tolist())).join(F.broadcast(cells), "cell").join(plan, "shelf")
    right = right.where(F.pmod(F.xxhash64("id", F.lit(1)), F.col("nth")) == 0)
    right = right.select("shelf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vector")

    def pack(questions: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(questions):
            return BLOCKS.empty_table()
        q = _matrix(questions.column("vector").combine_chunks(), dims)
        first, number = _copies(q)
        q = q[first]
        bound = np.full(len(q), np.inf)
        if len(rows) >= k:
            best = _Best(q, bound, k)
            ids, m = np.arange(len(rows)), _matrix(rows.column("vector").combine_chunks(), dims)
            few = _few_copies(m, ids, k)
            best.add(ids[few], m[few], np.arange(len(q)))
            bound = best.away[:, -1]
        middle, radius = _ball(q)
        qids = np.asarray(questions.column("qid")).astype(np.int64)
        return pa.table(
            {
                "block": [int(qids.min())], "at": [middle.tolist()], "reach": [radius + float(np.sqrt(bound.max()))], "qids": [qids.tobytes()],
                "number": [number.astype(np.int32).tobytes()], "asked": [q.tobytes()], "bounds": [bound.tobytes()],
            },
            BLOCKS,
        )

    kind = "block long, at array<double>, reach double, qids binary, number binary, asked binary, bounds binary"
    return left.groupBy("shelf", "block").cogroup(right.groupBy("shelf", "block")).applyInArrow(pack, kind)


def _reached(blocks: DataFrame, known: _Cells) -> list[int]:
    """The cells that some question may have to visit by its bound; at most as many as there are centres."""
    shared, dims = blocks.sparkSession.sparkContext.broadcast(known), known.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(shared.value.number))
        some = np.zeros(len(every), bool)
        for batch in batches:
            for asked, bounds in zip(*batch.columns, strict=True):
                q, bound = _vectors_of(asked.as_py(), dims), np.sqrt(np.frombuffer(bounds.as_py()))
                for a in range(0, len(q), 256):
                    some |= (shared.value.least(q[a : a + 256], every) <= bound[a : a + 256, None]).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value.number[some])], ["cell"])

    return [r["cell"] for r in blocks.select("asked", "bounds").mapInArrow(run, "cell int").distinct().collect()]


def _nearest(blocks: DataFrame, shelved: DataFrame, known: _Cells, k: int) -> DataFrame:
    """Blocks of questions meet the shelves that may hold something as near as their bounds -> qid, id, _distance: the best k of each task."""
    shared, dims = blocks.sparkSession.sparkContext.broadcast(known), known.centres.shape[1]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, {}
        for batch in batches:
            for block, qids, number, asked, bounds, cells, ids, held in zip(*(c for c in batch.columns), strict=True):
                q = _vectors_of(asked.as_buffer(), dims)
                if (block := block.as_py()) not in seen:
                    seen[block] = _Best(q.copy(), np.frombuffer(bounds.as_buffer()), k), qids.as_py(), number.as_py()
                best, m = seen[block][0], _vectors_of(held.as_buffer(), dims)
                ids, cells = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(cells.as_buffer(), np.int32)
                own, first = np.unique(cells, return_index=True)
                may = known.least(best.q, np.searchsorted(known.number, own)) <= np.sqrt(best.limit)[:, None]
                for i, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(cells)], strict=True)):
                    if len(asks := np.flatnonzero(may[:, i])):
                        best.add(ids[a:b], m[a:b], asks)
        for best, qids, number in seen.values():
            number = np.frombuffer(number, np.int32)
            for first in range(0, len(number), 4096):
                some = number[first : first + 4096]
                row, rank = np.nonzero(np.isfinite(best.away[some]))
                found = np.frombuffer(qids, np.int64)[first : first + 4096][row], best.id[some[row], rank], best.away[some[row], rank]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["qid", "id", "_distance"])

    apart = F.sqrt(F.aggregate(F.zip_with("at", "middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = blocks.join(shelved, apart <= (F.col("reach") + F.col("far")) * (1 + SLACK))
    return pairs.select("block", "qids", "number", "asked", "bounds", "cells", "ids", "held").mapInArrow(compare, "qid long, id long, _distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("qid").orderBy("_distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, path: str, k: int, scratch: str, key: str = "id") -> DataFrame:
    """queries (qid long, distinct, vector) -> qid, key, _distance (squared L2), rank: the exact nearest k; ties by key.

    scratch: a new folder for what is read more than once. Null and zero questions have no neighbours.
    """
    spark = queries.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{scratch}/{name}")
        return spark.read.schema(df.schema).parquet(f"{scratch}/{name}")

    known = _Cells(cells_of(spark, path))
    if not len(known.number):
        return spark.createDataFrame([], f"qid long, {key} long, _distance double, rank int")
    vectors, shelf = spark.read.parquet(f"{path}/vectors"), known.shelves()
    shelf_of = spark.createDataFrame([(int(c), int(s)) for c, s in zip(known.number, shelf, strict=True)], "cell int, shelf int")
    blocks = keep(_blocks(_rows(queries, "qid", "qid"), vectors, known, shelf, k), "blocks")
    vectors = vectors.where(F.col("cell").isin(_reached(blocks, known)))  # the folders of other cells are not read
    shelved = keep(_shelved(vectors, shelf_of, k, known.centres.shape[1]), "shelves")
    return _best(_nearest(blocks, shelved, known, k), k).withColumnRenamed("id", key)


def unit(df: DataFrame) -> DataFrame:
    """df with its vectors scaled to length 1; null and zero ones become null."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    # The length is bound once: inside the lambda over elements it would be computed for each.
    scaled = F.element_at(F.transform(F.array(length), lambda n: F.when(n > 0, F.transform("vector", lambda x: x.cast("double") / n))), 1)
    return df.withColumn("vector", scaled)


def nearest_stored(queries: DataFrame, path: str, threshold: float, scratch: str) -> DataFrame:
    """queries (qid long, distinct, vector) -> qid, entry, similarity (cosine) of the most similar entry at or above threshold.

    The index below path is that of unit() vectors, with entries as its key; of them, |a - b|^2 = 2 - 2 cos, so the nearest is the most
    similar. Equal similarities go to the smallest entry.
    """
    near = search(unit(queries), path, 1, scratch, key="entry").select("qid", "entry", (1 - F.col("_distance") / 2).alias("similarity"))
    return near.where(F.col("similarity") >= threshold)


def visited(path: str, scratch: str, spark: SparkSession, k: int) -> DataFrame:
    """After a search: qid, n_cells and n_vectors: how many cells each question may have to visit by its bound, of all, and the vectors in them."""
    known = _Cells(cells_of(spark, path))
    shared, dims = spark.sparkContext.broadcast(known), known.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qids, number, asked, bounds in zip(*batch.columns, strict=True):
                q, bound = _vectors_of(asked.as_py(), dims), np.sqrt(np.frombuffer(bounds.as_py()))
                every = np.arange(len(shared.value.number))
                may = np.concatenate([shared.value.least(q[a : a + 256], every) <= bound[a : a + 256, None] for a in range(0, len(q), 256)])
                own = np.frombuffer(number.as_py(), np.int32)
                counts = may.sum(axis=1)[own], (may @ shared.value.n)[own]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(qids.as_py(), np.int64)), *map(pa.array, counts)], ["qid", "n_cells", "n_vectors"])

    return spark.read.parquet(f"{scratch}/blocks").select("qids", "number", "asked", "bounds").mapInArrow(run, "qid long, n_cells long, n_vectors long")
