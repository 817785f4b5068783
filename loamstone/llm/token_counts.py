"""Token counts of documents in flat token files, by scanning for separators.

A token file is a stream of fixed-width token ids; an end-of-document id
follows each document and nothing else says where documents lie. A file
is read in byte ranges of whole blocks, each by a task of its own:
 1. in each block a vectorised comparison finds the separators;
 2. prefix sums of tokens and separators and a prefix maximum of the last
    separator's place run over the blocks, inside groups of GROUP blocks first and then over the groups,
    so that one long file is not one task's work;
 3. a block's first document starts where the last separator before it was,
    in whichever block; the others lie between separators of the block.

`write_files` writes such files, one for each partition of documents, and returns
their names with the order of the documents in them; `read_files` reads them, or flat files that others wrote.
Files are reached through the file system of their URI (local or mounted, HDFS, S3, GCS), which all executors must share.
A task writes under a name of its own, which only the rows of its committed attempt mention; what a lost executor left is read for nothing.

Defined results:
 - null or empty text: no tokens; text that spells a special token is ordinary text;
 - null or repeated doc_id: each row is a document of its own;
 - empty documents, and separators at block ends: count 0 where nothing lies between;
 - tokens after the last separator: one more document, not closed;
 - very long runs of blanks, which the splitting pattern cannot match in one go: cut out as the pattern would (all of a run but
   its last blank, or all of it at the end of a text) and encoded as the one piece that they are, so ids are those of the whole;
 - very long texts and files: whole, over as many blocks and ranges as they take; an empty table or file gives an empty result;
 - an id that does not fit the width, or a file that is no whole number of tokens, is an error;
 - other columns are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks of a group in the two-level prefix scan.
GROUP = 4096
#: The public byte-level BPE splitting pattern (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Blanks as the pattern's \\s knows them (Unicode's White_Space, fixed values), in runs that are too long for its lookahead to step back over.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")

_encoders: dict[int, object] = {}


def encoder(ranks_file: bytes, pattern: str = PATTERN):
    """The tiktoken encoding of a file of ranks, made once a process."""
    key = hash((ranks_file, pattern))
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encode(enc, text: str) -> list[int]:
    """The ids of a text by an encoder of PATTERN, whatever its length and its runs.

    The pattern backtracks over a run of blanks one by one and gives up on about a million. Before such a run a piece always ends;
    the run is one piece, without the last blank if more text follows, which goes with what follows.
    """
    out, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        cut = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : cut])
        at = cut
    return out + enc.encode_ordinary(text[at:])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "/", uri)))


def write_files(
    docs: DataFrame, folder: str, ranks_path: str, *, end: int = 50256, width: int = 2, pattern: str = PATTERN
) -> DataFrame:
    """docs (doc_id, text) -> file, place, doc_id: a row for each document; the file of each partition holds its tokens.

    The file of ranks is read by the driver and sent along, so executors need
    no copy. With a pattern of one's own, texts are encoded as that pattern can. Tokens are little-endian and `width` bytes wide. The files are written when
    the rows are, so write the rows once.
    """
    with open(ranks_path, "rb") as f:
        ranks_file = f.read()
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, place = encoder(ranks_file, pattern), 0
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tokens"
        system, path = _open(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as out:
            for batch in batches:
                for text in batch.column(1):
                    ids = np.array([*(encode(enc, text.as_py() or "") if pattern == PATTERN else enc.encode_ordinary(text.as_py() or "")), end], dtype=np.uint64)
                    if int(ids.max()) >> (8 * width):
                        raise ValueError(f"token id {int(ids.max())} does not fit into {width} bytes")
                    out.write(ids.astype(kind).tobytes())
                n = len(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(range(place, place + n), pa.int64()), batch.column(0)], ["file", "place", "doc_id"]
                )
                place += n

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "file string, place long, doc_id long")


def file_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """file, first byte and length of each range of the files that a path or a list of paths names; lists names and lengths alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("length > 0").select("file", "length", F.explode(starts).alias("first"))
    return ranges.select("file", "first", F.least(F.lit(range_bytes).cast("long"), F.col("length") - F.col("first")).alias("n"))


def read_files(spark: SparkSession, path, *, width: int = 2, block_tokens: int = 8192, range_blocks: int = 512) -> DataFrame:
    """Flat token files -> stream (the file), block, tokens. A range of range_blocks blocks is a unit of work, whatever the size of its file."""
    step = block_tokens * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if n % width:
                    raise ValueError(f"{name} is no whole number of tokens of {width} bytes")
                system, inner = _open(name)
                with system.open_input_file(inner) as f:
                    f.seek(first)
                    data = f.read(n)
                if len(data) != n:
                    raise OSError(f"{name}: {len(data)} of {n} bytes at {first}")
                parts = [data[i : i + step] for i in range(0, n, step)]
                number = range(first // step, first // step + len(parts))
                columns = [pa.array([name] * len(parts), pa.string()), pa.array(number, pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["stream", "block", "tokens"])

    ranges = file_ranges(spark, path, step * range_blocks)
    tasks = max(1, min(ranges.count(), 4 * spark.sparkContext.defaultParallelism, 1 << 15))
    return ranges.repartition(tasks, "file", "first").mapInArrow(run, "stream string, block long, tokens binary")


def separators(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """blocks (stream, block, tokens) -> stream, block, n, ends: the places of the separators in each block."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t.as_py() or b"", dtype=kind) for t in batch.column(2)]
            found = [np.flatnonzero(t == end).astype(np.int32) for t in tokens]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            n = pa.array([len(t) for t in tokens], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, lists], ["stream", "block", "n", "ends"])

    stream = blocks.schema["stream"].dataType.simpleString()
    return blocks.select("stream", "block", "tokens").mapInArrow(run, f"stream {stream}, block long, n long, ends array<int>")


def document_lengths(found: DataFrame) -> DataFrame:
    """What separators() returns -> stream, place (the document's number in its stream), n_tokens, closed."""
    group = F.floor(F.col("block") / GROUP)
    rows = found.select("*", group.alias("g"))
    inside = W.partitionBy("stream", "g").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    many = F.size("ends")
    rows = rows.select("*", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("start"))
    last = F.when(many > 0, F.col("start") + F.element_at("ends", -1))
    rows = rows.select("*", last.alias("last"))
    rows = rows.select(
        "*",
        F.coalesce(F.sum(many).over(inside), F.lit(0)).alias("before"),
        F.max("last").over(inside).alias("open"),
    )
    groups = rows.groupBy("stream", "g").agg(F.sum("n").alias("n"), F.sum(many).alias("ends"), F.max("last").alias("last"))
    over = W.partitionBy("stream").orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("*", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("g_start"))
    groups = groups.select("*", (F.col("g_start") + F.col("last")).alias("g_last"))
    groups = groups.select(
        "stream", "g", "n", "ends", "g_start", "g_last",
        F.coalesce(F.sum("ends").over(over), F.lit(0)).alias("g_before"),
        F.coalesce(F.max("g_last").over(over), F.lit(-1)).alias("g_open"),
    )
    offsets = groups.select("stream", "g", "g_start", "g_before", "g_open")
    rows = rows.join(offsets, ["stream", "g"])
    start = F.col("g_start") + F.col("start")
    opened = F.coalesce(F.col("g_start") + F.col("open"), F.col("g_open"))

    def document(end, i):
        since = F.when(i == 0, opened).otherwise(start + F.element_at("ends", F.greatest(i, F.lit(1))))
        return F.struct((F.col("g_before") + F.col("before") + i).alias("place"), (start + end - since - 1).alias("n_tokens"))

    closed = rows.select("stream", F.explode(F.transform("ends", document)).alias("d"))
    closed = closed.select("stream", F.col("d.place").cast("long").alias("place"), F.col("d.n_tokens").cast("long").alias("n_tokens"), F.lit(True).alias("closed"))
    totals = groups.groupBy("stream").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max("g_last").alias("last"))
    rest = totals.select(
        "stream", F.col("ends").cast("long").alias("place"), (F.col("n") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(rest.where("n_tokens > 0"))
