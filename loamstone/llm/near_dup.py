"""MinHash near-duplicates: one-permutation hashing, optimal densification, star-shaped candidate edges.

 1. A text's set is its distinct n-word shingles, hashed to 64 bits for the
    sketch with a key drawn for each run, so that no text can be made to hold shingles that collide. Texts of the same words in the same order (told by SHA-256 of the
    words) form a class, and one document stands for it.
 2. One permutation deals the hashes to bins and keeps each bin's smallest;
    an empty bin borrows from the bins that a universal hash walks to until
    one is filled (optimal densification), the same walk for all documents.
 3. Bands of bins are hashed into buckets. A bucket does not emit its pairs:
    it links a centre to its members.
 4. In buckets whose members are then in several components, the members outside
    the centre's component are compared with those of all others whose size allows
    a link, in blocks bounded in rows and shingles that propose a spanning set of links. So every
    pair that shares a bucket is either linked through a component
    or compared, large groups of copies cost a star, and no pairs are emitted.
 5. Every link, of a star or of a block, is confirmed on the full sets of the two
    texts, word by word; no hash decides it.

With 42 bands of 6 bins a pair of similarity s shares no bucket with
probability (1 - s^6)^42, 3e-6 at 0.8.

Defined results:
 - null or empty text, or without words: empty set, linked with nothing;
 - fewer words than a shingle: the whole sequence is the one shingle;
 - null doc_id: linked with nothing, kept, component_id null;
 - rows that repeat a doc_id are one node, linked if any of its texts is;
 - very long texts: whole, a block of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm import textvec
from loamstone.llm.common import discard, materialise
from loamstone.llm.graph import components

U = np.uint64
BANDS, BAND_BINS = 42, 6
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def _walk(step: int, bins: int) -> np.ndarray:
    """The bin that each bin tries in this step; later steps go round all bins, so that the walk ends."""
    j = np.arange(bins, dtype=U)
    if step < 256:
        return (textvec.mix64(j * U(0x9E3779B97F4A7C15) + U(step + 1)) % U(bins)).astype(np.int64)
    return ((j + U(step - 255)) % U(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification; a row for each set, none of which may be empty."""
    sig = np.full((len(sets), bins), _EMPTY, dtype=U)
    sizes = np.array([len(s) for s in sets])
    g = textvec.mix64(np.concatenate(sets) ^ U(0x5851F42D4C957F2D))
    flat = np.repeat(np.arange(len(sets)), sizes) * bins + ((g >> U(40)) % U(bins)).astype(np.int64)
    value = g & U((1 << 40) - 1)
    order = np.argsort(value)[::-1]
    sig.ravel()[flat[order]] = value[order]  # the last, that is the smallest, stays
    own = sig.copy()
    step, open_rows = 0, np.flatnonzero((sig == _EMPTY).any(axis=1))
    while len(open_rows):
        got = own[open_rows][:, _walk(step, bins)]
        part = sig[open_rows]
        sig[open_rows] = np.where(part == _EMPTY, got, part)
        open_rows = open_rows[(sig[open_rows] == _EMPTY).any(axis=1)]
        step += 1
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit bucket key for each band of each row."""
    parts = sig.reshape(len(sig), bands, -1)
    x = np.broadcast_to(textvec.mix64(np.arange(1, bands + 1, dtype=U)), parts.shape[:2])
    for j in range(parts.shape[2]):
        x = textvec.mix64(x * U(0xD6E8FEB86659FD93) + parts[:, :, j])
    return x


def _list_column(flat: np.ndarray, sizes) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sets_of(batch: pa.RecordBatch, words: int, key: int) -> Iterator[tuple[pa.Array, list[np.ndarray], list[bytes]]]:
    """Ids, sets and texts of runs of rows."""
    for first, data, offsets in textvec.chunks(batch.column("text")):
        starts, stops, rows = textvec.words(data, offsets)
        sets = list(textvec.shingle_sets(textvec.span_hashes(textvec.folded(data), starts, stops, key), rows, words))
        texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield batch.column("doc_id").slice(first, len(sets)), sets, texts


def _digest(text: bytes) -> bytes:
    """SHA-256 of the words; bytes.lower and bytes.split know A-Z and the six blanks alone."""
    return hashlib.sha256(b" ".join(text.lower().split())).digest()


def sketch(docs: DataFrame, words: int, bands: int = BANDS, band_bins: int = BAND_BINS, key: int = 0) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n, digest (of the words), keys (bucket keys, empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets, texts in _sets_of(batch, words, key):
                n = np.array([len(s) for s in sets], dtype=np.int64)
                some = [s for s in sets if len(s)]
                keys = band_keys(signatures(some, bands * band_bins), bands) if some else np.zeros((0, bands), dtype=U)
                columns = [ids, pa.array(n), pa.array(list(map(_digest, texts)), pa.binary())]
                columns.append(_list_column(keys.ravel(), np.where(n > 0, bands, 0)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "keys"])
        textvec.release_memory()

    schema = "doc_id long, n long, digest binary, keys array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def shingled(docs: DataFrame, words: int, key: int = 0) -> DataFrame:
    """docs (doc_id, text) -> doc_id, shingles (array of distinct hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets, _ in _sets_of(batch, words, key):
                column = _list_column(np.concatenate(sets), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([ids, column], ["doc_id", "shingles"])
        textvec.release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, shingles array<long>"
    )


def _texts_of(docs: DataFrame, nodes: DataFrame, broadcast_rows: int) -> DataFrame:
    """docs (doc_id, text) of the nodes."""
    small = F.broadcast(nodes) if nodes.limit(broadcast_rows + 1).count() <= broadcast_rows else nodes
    return docs.join(small, F.col("doc_id").cast("long") == F.col("node"), "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, broadcast_rows: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union of their full sets, by their words."""

    def linked(pairs: list[tuple[int, int, bytes, bytes]]) -> Iterator[tuple[int, int]]:
        place: dict[bytes, int] = {}
        at = [(place.setdefault(x, len(place)), place.setdefault(y, len(place))) for _, _, x, y in pairs]
        sets = textvec.exact_sets(list(place), words)
        for (a, b, _, _), (i, j) in zip(pairs, at, strict=True):
            x, y = sets[i], sets[j]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) > 0:
                shared = len(x) if i == j else len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, found = [], 0, []
            texts = [batch.column(c).cast(pa.large_binary()) for c in (2, 3)]
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = (t[i].as_py() or b"" for t in texts)
                held.append((a, b, x, y))
                size += len(x) + len(y)
                if size >= textvec.CHUNK_BYTES:
                    found.extend(linked(held))
                    held, size = [], 0
            found.extend(linked(held))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        textvec.release_memory()

    nodes = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    texts = materialise(_texts_of(docs, nodes, broadcast_rows).where("text IS NOT NULL").distinct(), "texts")
    of = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"t{name}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb")
    links = materialise(both.mapInArrow(run, "a long, b long").distinct(), "links")
    discard(nodes, texts)
    return links


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """One block pair: side 0 against side 1, as links (a, b) that connect the components which any of its links connects."""
    side = np.asarray(table["side"].combine_chunks())
    rep, comp = np.asarray(table["rep"].combine_chunks()), np.asarray(table["component"].combine_chunks())
    lists = table["shingles"].combine_chunks()
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    owner, flat = np.repeat(np.arange(len(rep)), sizes), np.asarray(lists.flatten())
    home, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    place = np.empty(len(rep), dtype=np.int64)
    place[home], place[other] = np.arange(len(home)), np.arange(len(other))
    of_home = side[owner] == 0
    names = np.intersect1d(flat[of_home], flat[~of_home])  # other shingles are in no intersection
    column = np.searchsorted(names, flat)
    held = (column < len(names)) & (names[np.minimum(column, len(names) - 1)] == flat) if len(names) else np.zeros(len(flat), bool)
    column, owner, of_home = column[held], owner[held], of_home[held]
    order = np.argsort(column, kind="stable")
    column, owner, of_home = column[order], owner[order], of_home[order]
    shared = np.zeros((len(home), len(other)), dtype=np.float32)
    for first in range(0, len(names), 2048):
        a, b = np.searchsorted(column, [first, first + 2048])
        dense = [np.zeros((len(x), 2048), dtype=np.float32) for x in (home, other)]
        for kind, m in enumerate(dense):
            use = of_home[a:b] == (kind == 0)
            m[place[owner[a:b][use]], column[a:b][use] - first] = 1
        shared += dense[0] @ dense[1].T
    union = sizes[home][:, None] + sizes[other][None, :] - shared
    linked = (100 * shared.astype(np.float64) >= percent * union) & (comp[home][:, None] != comp[other][None, :])
    x, y = np.nonzero(linked)
    chosen = _forest(comp[home[x]], comp[other[y]])
    return pa.table({"a": rep[home[x[chosen]]], "b": rep[other[y[chosen]]]})


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places of some of the edges (a, b) that connect what all of them do: in each round every tree takes its first edge outwards."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label, edge = np.arange(len(names)), np.arange(len(a))
    taken = []
    while len(edge):
        first = np.full(len(names), len(a) + len(edge))
        np.minimum.at(first, label[a[edge]], edge)
        np.minimum.at(first, label[b[edge]], edge)
        pick = np.unique(first[first < len(a)])
        taken.append(pick)
        while True:  # what the picked edges connect gets one label
            low = np.minimum(label[a[pick]], label[b[pick]])
            new = label.copy()
            np.minimum.at(new, label[a[pick]], low)
            np.minimum.at(new, label[b[pick]], low)
            new = new[new[label]]
            if (new == label).all():
                break
            label = new
        edge = edge[label[a[edge]] != label[b[edge]]]
    return np.unique(np.concatenate(taken)) if taken else np.zeros(0, dtype=np.int64)


def across(
    members: DataFrame, component: DataFrame, docs: DataFrame, words: int, percent: int, block: int, block_shingles: int, broadcast_rows: int, key: int = 0
) -> DataFrame:
    """Candidate links (a, b) between different components that share a bucket; by hashes, so still to be confirmed.

    A bucket's members outside its centre's component are compared with its
    members of like size, a block of each in a task: sets whose sizes differ by more than the
    similarity allows are never brought together. Sizes are told by steps of 100 / percent, so only equal and
    neighbouring steps meet. A block has about `block` rows and `block_shingles` shingles at most, or one text. A large
    group of copies is one component by now, so the cost is that of the few
    which are not in it, and a block returns fewer links than it has components.
    """
    placed = members.join(component, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    placed = materialise(placed, "placed")
    spans = placed.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("rep", "component"))["component"].alias("main")
    )
    spans = materialise(spans.where("lo < hi").select("key", "main"), "spans")
    step = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent) + 1e-9).cast("int")
    apart = F.col("component") != F.col("main")
    rest = materialise(placed.join(spans, "key").select("key", "rep", "component", step.alias("step"), "n", apart.alias("apart")), "rest")
    rows = lambda on: F.count_if(on) if on is not None else F.count("*")
    blocks = lambda count, size: F.greatest(F.ceil(count / block), F.ceil(size / block_shingles)).cast("int")
    counts = rest.groupBy("key", "step").agg(
        blocks(rows(F.col("apart")), F.sum(F.when(F.col("apart"), F.col("n")).otherwise(0))).alias("hbs"), blocks(rows(None), F.sum("n")).alias("cbs")
    )
    # A row a bucket: its few steps (sizes up to 2^31 make 96 of them at 80 %) with the blocks of each.
    counts = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("step", F.struct("hbs", "cbs")))).alias("blocks"))
    counts = materialise(counts, "counts")
    luck, none = F.xxhash64("rep"), F.array().cast("array<struct<hs:int,h:int,os:int,c:int,side:int>>")
    own = F.col("blocks")[F.col("step")]

    def upto(n, of):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), of)).otherwise(none)

    def group(hs, h, os, c, side):
        return F.struct(hs.alias("hs"), h.cast("int").alias("h"), os.alias("os"), c.cast("int").alias("c"), F.lit(side).alias("side"))

    def visits_to(d: int):
        there = (F.col("step") + d).cast("int")
        that = F.col("blocks")[there]
        home = upto(that["cbs"], lambda c: group(F.col("step"), F.pmod(luck, own["hbs"]), there, c, 0))
        guest = upto(that["hbs"], lambda h: group(there, h, F.col("step"), F.pmod(luck, own["cbs"]), 1))
        return F.concat(F.when(F.col("apart"), home).otherwise(none), guest)

    near = [F.coalesce(visits_to(d), none) for d in (-1, 0, 1)]
    visits = rest.join(counts, "key").select("key", "rep", "component", F.explode(F.concat(*near)).alias("g")).select("key", "rep", "component", "g.*")

    nodes = materialise(visits.select(F.col("rep").alias("node")).distinct(), "nodes")
    sets = materialise(shingled(_texts_of(docs, nodes, broadcast_rows), words, key), "sets")
    full = visits.join(sets.withColumnRenamed("doc_id", "s"), F.col("rep") == F.col("s")).drop("s")

    def compare(table: pa.Table) -> pa.Table:
        return _compare(table, percent)

    return full.groupBy("key", "hs", "h", "os", "c").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = BANDS, band_bins: int = BAND_BINS,
    block: int = 1024, block_shingles: int = 1 << 21, broadcast_rows: int = 500_000,
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    docs = docs.select("doc_id", "text")
    key = secrets.randbits(64)
    sketches = materialise(sketch(docs, words, bands, band_bins, key), "sketches")
    linked = sketches.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = materialise(linked.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    member = linked.join(classes, "digest")

    # Buckets of the representatives that hold more than one.
    buckets = materialise(
        member.where("doc_id = rep").select("rep", "n", F.explode("keys").alias("key")), "buckets"
    )
    shared = buckets.groupBy("key").agg(
        F.min("rep").alias("centre"), F.max("rep").alias("hi"), F.min(F.struct("rep", "n"))["n"].alias("n_centre")
    )
    shared = materialise(shared.where("centre < hi").drop("hi"), "shared")
    members = materialise(buckets.join(shared, "key"), "members")
    discard(buckets, shared)

    size_ok = 100 * F.least("n", "n_centre") >= percent * F.greatest("n", "n_centre")
    star = members.where((F.col("rep") != F.col("centre")) & size_ok)
    pairs = materialise(star.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = confirmed(pairs, docs, words, percent, broadcast_rows)

    # An id with several texts joins their classes.
    ids = member.select("doc_id", "rep")
    several = ids.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    links = links.unionByName(ids.join(several, "doc_id").select("a", F.col("rep").alias("b")))
    component = materialise(components(links), "components")

    # What the stars leave apart is compared in blocks.
    more = materialise(across(members, component, docs, words, percent, block, block_shingles, broadcast_rows, key), "across")
    if not more.isEmpty():
        more = confirmed(more, docs, words, percent, broadcast_rows)
        component = materialise(components(links.unionByName(more)), "components")

    # Each class with its component, then each document with its class.
    named = classes.join(component, F.col("rep") == F.col("node"), "left")
    named = materialise(named.select("digest", F.coalesce("component", "rep").alias("component")), "named")
    out = sketches.select("doc_id", "n", "digest").join(named.hint("merge"), "digest", "left")
    # A null doc_id is no node, though its text may equal that of a class.
    ident = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        ident.alias("component_id"),
        F.coalesce(F.col("doc_id") == ident, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, *, broadcast_rows: int = 500_000, **params) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; rows without an id stay."""
    judged = near_duplicates(docs, broadcast_rows=broadcast_rows, **params)
    gone = materialise(judged.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    small = F.broadcast(gone) if gone.limit(broadcast_rows + 1).count() <= broadcast_rows else gone
    return docs.join(small, docs["doc_id"] == small["_gone"], "left_anti")
