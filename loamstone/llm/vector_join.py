"""Exact cosine range join of embeddings as a metric join over pivot cells.

On unit vectors cosine >= c is a Euclidean distance of at most
r = sqrt(2 - 2c). The join has four steps:
 1. equal vectors become one with a multiplicity, so copies cost nothing;
 2. pivots, farthest first among a bounded sample, partition the vectors: each goes to its nearest pivot's cell. A cell
    with far more than `block` vectors is split again by pivots of its own, unless it is so small in
    diameter that all its vectors link, or the pivots, which are sent to every task, would exceed PIVOT_BYTES;
 3. a vector b of cell i is replicated to cell j if it may have a partner there, by the triangle
    inequality: among the cells of one split, with pi nearest to b, |b pj| <= |b pi| + 2r, |b pj| <= radius of j + r, and the same bound
    for the plane halfway between the pivots, |b pj|^2 - |b pi|^2 <= 2 r |pi pj|. Of two cells only
    one receives the other's vectors;
 4. cells join independently, in blocks of at most about `block` vectors a side, so a cell that
    holds most of the data costs more tasks and not more memory. A cell of radius at most r / 2
    links all its own vectors without comparing them. Products are taken in single
    precision with a margin, and what passes is decided in double precision from the components as they
    are given, as dot / sqrt(|a|^2 |b|^2), so that ties at the threshold count as links.

The pivots are the only fitted part; they change the cost and never the result.
A block reports counts and the components of its own links, so its output is
linear in its rows however many links there are.

Defined results:
 - null, empty or zero vectors, or with null or non-finite components: linked with nothing, component their own id;
 - components keep the type of the column, float or double; other numbers are taken as doubles;
 - vectors of different lengths: not linked;
 - null vec_id: linked with nothing and counted by nobody, component null, kept;
 - rows that repeat a vec_id: vectors of their own for the counts, one node for the components;
 - an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import discard, materialise
from loamstone.llm.graph import components

#: Pivots of one split, and bytes of all pivots together.
MAX_PIVOTS = 1024
PIVOT_BYTES = 64 << 20
#: Distances of unit vectors are known to about this; bounds are widened by it.
SLACK = 1e-6


def valid(v: Column) -> Column:
    """Whether v has a direction: its length is positive and every component finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.exists(v, lambda x: x != 0) & ~bad, F.lit(False))


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component is about one: cosines stay the same to the bit and nothing overflows."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (u @ pivots.T), 0))


def choose_pivots(pool: np.ndarray, count: int) -> np.ndarray:
    """`count` pivots, farthest first, among the unit vectors of the pool."""
    chosen, near = [0], _distances(pool, pool[:1])[:, 0]
    while len(chosen) < min(count, len(pool)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(pool, pool[chosen[-1:]])[:, 0])
    return pool[chosen]


class Cells:
    """A tree of cells. Node 0 holds all vectors; a node that was split has a pivot and a covering radius for each child."""

    def __init__(self):
        self.pivots: dict[int, np.ndarray] = {}
        self.children: dict[int, np.ndarray] = {}
        self.radius: dict[int, float] = {0: 0.0}
        self.count = 1

    def split(self, node: int, pivots: np.ndarray) -> None:
        self.pivots[node], self.children[node] = pivots, np.arange(self.count, self.count + len(pivots))
        self.count += len(pivots)

    def bytes(self) -> int:
        return sum(p.nbytes for p in self.pivots.values())

    def assign(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector and its distance to the leaf's pivot."""
        leaf, far = np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, at = todo.pop()
            leaf[at] = node
            if node in self.pivots and len(at):
                d = _distances(unit[at], self.pivots[node])
                best = d.argmin(axis=1)
                far[at] = d[np.arange(len(at)), best]
                todo += [(int(self.children[node][c]), at[best == c]) for c in np.unique(best)]
        return leaf, far

    def reached(self, unit: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that may hold a vector within the radius of the row's."""
        rows, leaves = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, at = todo.pop()
            if node not in self.pivots:
                rows.append(at)
                leaves.append(np.full(len(at), node))
                continue
            pivots, children = self.pivots[node], self.children[node]
            d = _distances(unit[at], pivots)
            best = d.argmin(axis=1)
            near = d[np.arange(len(at)), best][:, None]
            to = d <= np.array([self.radius.get(int(c), -9.0) for c in children]) + radius
            to &= d <= near + 2 * radius
            to &= d * d - near * near <= 2 * radius * _distances(pivots, pivots)[best] + SLACK
            todo += [(int(children[c]), at[to[:, c]]) for c in np.flatnonzero(to.any(axis=0))]
        return np.concatenate(rows), np.concatenate(leaves)


def _cells(vectors: DataFrame, radius: float, block: int, least_cells: int) -> tuple[Cells, DataFrame, dict[int, tuple[int, int]]]:
    """The tree; vectors with their cell; of each cell, how many vectors and copies it has."""
    cells, kind = Cells(), vectors.schema["vec"].dataType.simpleString()
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("rep", "tag")).limit(4 * max(least_cells, min(MAX_PIVOTS, -(-n // block)))).select("vec").collect()
    cells.split(0, choose_pivots(_unit(np.array([r["vec"] for r in rows], dtype=np.float64)), max(least_cells, min(MAX_PIVOTS, -(-n // block)))))
    while True:

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    leaf, far = cells.assign(_unit(_matrix(batch.column("vec"))))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(far)], ["rep", "tag", "mult", "vec", "cell", "far"])

        homes = vectors.select("rep", "tag", "mult", "vec").mapInArrow(assign, f"rep long, tag long, mult long, vec {kind}, cell int, far double")
        homes = materialise(homes, "homes")
        sizes = {}
        for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.sum("mult").alias("copies"), F.max("far").alias("far")).collect():
            cells.radius[r["cell"]], sizes[r["cell"]] = r["far"], (r["n"], r["copies"])
        dim, room = next(iter(cells.pivots.values())).shape[1], PIVOT_BYTES - cells.bytes()
        big = {}
        for cell, (m, _) in sorted(sizes.items(), key=lambda x: -x[1][0]):
            want = min(MAX_PIVOTS, -(-m // block))
            if m > 4 * block and 2 * cells.radius[cell] > radius and 8 * dim * want <= room:
                big[cell], room = want, room - 8 * dim * want
        if not big:
            return cells, homes, sizes
        # About 4 vectors for each pivot, by hash: at most 4 times the pivots' bytes in all.
        luck = F.pmod(F.xxhash64("rep", "tag", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
        share = F.create_map(*[F.lit(x) for cell, want in big.items() for x in (cell, 4.0 * want / sizes[cell][0])])
        pools: dict[int, list] = {}
        for r in homes.where(luck < F.coalesce(share[F.col("cell")], F.lit(0.0))).select("cell", "vec").collect():
            pools.setdefault(r["cell"], []).append(r["vec"])
        before = cells.count
        for cell, pool in sorted(pools.items()):
            pivots = choose_pivots(_unit(np.array(pool, dtype=np.float64)), big[cell])
            if len(pivots) > 1:
                cells.split(cell, pivots)
        if cells.count == before:
            return cells, homes, sizes
        discard(homes)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _join_block(table: pa.Table, cosine: float, own: bool) -> pa.Table:
    """The links of one block pair, or of a block with itself (own): node, tag, links (with multiplicities), root; only for nodes that have links."""
    side = np.asarray(table["side"].combine_chunks())
    rep, mult = np.asarray(table["rep"].combine_chunks()), np.asarray(table["mult"].combine_chunks())
    order = np.lexsort((rep, side))
    rep, mult, side = rep[order], mult[order], side[order]
    exact = _scaled(_matrix(table["vec"])[order])
    square = np.einsum("ij,ij->i", exact, exact)
    unit = exact / np.sqrt(square)[:, None]
    homes = int((side == 0).sum())
    f32 = unit.astype(np.float32)
    margin = 4e-6 * max(unit.shape[1], 64)
    links = np.zeros(len(rep), dtype=np.int64)
    rank = np.argsort(np.argsort(rep, kind="stable"), kind="stable")
    label = np.arange(len(rep))  # by rank of id
    by_rank = np.argsort(rank)
    first_other = 0 if own else homes
    others = f32[first_other:]
    for at in range(0, homes, 512):
        end = min(at + 512, homes)
        a, b = np.nonzero(f32[at:end] @ others.T >= np.float32(cosine - margin))
        a, b = a + at, b + first_other
        if own:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 1 << 18):
            x, y = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
            good = np.einsum("ij,ij->i", exact[x], exact[y]) / np.sqrt(square[x] * square[y]) >= cosine
            x, y = x[good], y[good]
            links += np.bincount(x, weights=mult[y], minlength=len(rep)).astype(np.int64)
            links += np.bincount(y, weights=mult[x], minlength=len(rep)).astype(np.int64)
            if len(x):
                label = _merge(label, rank[x], rank[y])
    some = np.flatnonzero(links)
    root = rep[by_rank[label[rank[some]]]]
    tag = np.asarray(table["tag"].combine_chunks())[order]
    return pa.table({"node": rep[some], "tag": tag[some], "links": links[some], "root": root})


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the links (a, b) added; label[i] is the smallest index in i's component."""
    return _roots(len(label), label[a], label[b])[label]


def _range_join(vectors: DataFrame, cosine: float, block: int, least_cells: int) -> tuple[DataFrame, DataFrame]:
    """vectors (rep, tag, mult, vec) of one length -> (node, tag, links), (a, b): counts without own copies; links for components."""
    radius = float(np.sqrt(2 - 2 * cosine)) + SLACK
    kind = vectors.schema["vec"].dataType.simpleString()
    cells, homes, sizes = _cells(vectors, radius, block, least_cells)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows, leaves = cells.reached(_unit(_matrix(batch.column("vec"))), radius)
            home = np.asarray(batch.column("cell"))[rows]
            to = (home < leaves) == ((home + leaves) % 2 == 0)  # of two cells one takes the other's
            to &= home != leaves
            rows, leaves = rows[to], leaves[to]
            order = np.argsort(rows, kind="stable")
            offsets = np.searchsorted(rows[order], np.arange(len(batch) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaves[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "targets"])

    homes = homes.drop("far").mapInArrow(replicate, f"rep long, tag long, mult long, vec {kind}, cell int, targets array<int>")
    homes = materialise(homes, "replicated")
    guests = {r[0]: r[1] for r in homes.select(F.explode("targets").alias("t")).groupBy("t").count().collect()}
    spark = vectors.sparkSession
    dense = {j for j in sizes if 2 * (cells.radius[j] + SLACK) <= radius - 2 * SLACK}
    plan = [(j, -(-m // block), -(-guests.get(j, 0) // block), j in dense, c) for j, (m, c) in sizes.items()]
    # A row for each cell: they are fewer than the pivots, whose bytes are bounded.
    plan = F.broadcast(spark.createDataFrame(plan, "c int, nb int, rb int, dense boolean, copies long"))

    luck = F.xxhash64("rep", "tag")
    at_home = homes.join(plan, F.col("cell") == F.col("c")).withColumn("h", F.pmod(luck, F.col("nb")).cast("int"))
    all_linked = at_home.where("dense")
    own_counts = all_linked.select(F.col("rep").alias("node"), "tag", (F.col("copies") - F.col("mult")).alias("links"))
    centre = all_linked.groupBy("cell").agg(F.min("rep").alias("root"))
    own_links = all_linked.join(centre, "cell").select("root", F.col("rep").alias("node"))

    def pairs(n: Column, of) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), of)).otherwise(
            F.array().cast("array<struct<hb:int,cb:int,side:int>>")
        )

    def group(hb, cb, side):
        return F.struct(hb.cast("int").alias("hb"), cb.cast("int").alias("cb"), F.lit(side).alias("side"))

    among = F.when(F.col("dense"), 0).otherwise(F.col("nb") - F.col("h"))
    as_home = pairs(among, lambda k: group(F.col("h"), F.col("h") + k, 0))
    as_host = pairs(F.col("rb"), lambda k: group(F.col("h"), F.col("nb") + k, 0))
    as_other = pairs(F.when(F.col("dense"), 0).otherwise(F.col("h")), lambda k: group(k, F.col("h"), 1))
    own = at_home.select("rep", "tag", "mult", "vec", "cell", F.explode(F.concat(as_home, as_host, as_other)).alias("g"))
    visit = homes.select("rep", "tag", "mult", "vec", F.explode("targets").alias("t")).join(plan, F.col("t") == F.col("c"))
    visit = visit.withColumn("k", F.pmod(luck, F.col("rb")).cast("int"))
    visit = visit.select(
        "rep", "tag", "mult", "vec", F.col("t").alias("cell"),
        F.explode(pairs(F.col("nb"), lambda h: group(h, F.col("nb") + F.col("k"), 1))).alias("g"),
    )
    blocks = own.unionByName(visit).select("rep", "tag", "mult", "vec", "cell", "g.*")

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, hb, cb = (k.as_py() for k in key)
        return _join_block(table, cosine, hb == cb)

    found = blocks.groupBy("cell", "hb", "cb").applyInArrow(join, "node long, tag long, links long, root long")
    found = materialise(found, "found")
    counts = found.select("node", "tag", "links").unionByName(own_counts).groupBy("node", "tag").agg(F.sum("links").alias("links"))
    return counts, found.select("root", "node").unionByName(own_links).select(F.col("root").alias("a"), F.col("node").alias("b"))


def cosine_join(vectors: DataFrame, *, cosine: float = 0.9, block: int = 4096, least_cells: int = 8) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> vec_id, n_links, component_id, kept; one row for each row of vectors."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    able = rows.where(F.col("vec_id").isNotNull() & valid(F.col("vec")))
    classes = able.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    classes = materialise(classes.withColumn("tag", F.xxhash64("vec")), "classes")  # (rep, tag) names a class
    spark = vectors.sparkSession
    counts = spark.createDataFrame([], "node long, tag long, links long")
    links = spark.createDataFrame([], "a long, b long")
    for size in sorted(r[0] for r in classes.select(F.size("vec")).distinct().collect()):
        c, e = _range_join(classes.where(F.size("vec") == size), cosine, block, least_cells)
        counts, links = counts.unionByName(c), links.unionByName(e)
    # An id with several vectors is one node, so it joins their classes.
    member = able.join(classes.hint("merge"), "vec").select("vec_id", "rep")
    several = member.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("vec_id", "a")
    links = links.unionByName(member.join(several, "vec_id").select("a", F.col("rep").alias("b")))
    tops = components(links)
    counts = counts.withColumnRenamed("tag", "t")
    named = classes.join(counts, (F.col("rep") == F.col("node")) & (F.col("tag") == F.col("t")), "left").drop("node").join(
        tops, F.col("rep") == F.col("node"), "left"
    )
    named = named.select(
        "vec",
        (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"),
        F.coalesce("component", "rep").alias("component"),
    )
    named = materialise(named, "named")
    key = F.when(F.col("vec_id").isNotNull() & valid(F.col("vec")), F.col("vec"))
    out = rows.select("vec_id", key.alias("vec")).join(named.hint("merge"), "vec", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
