"""Line deduplication over levelled sorted runs of line hashes.

One pass over the texts turns their lines into postings (digest, doc_id), dealt to batches. The digest is the first half of
the SHA-256 of the folded line, so no two lines that anybody can name share one. A `LineRuns` store holds
runs (digest, number of documents, largest doc_id); a run is a table of buckets
by digest, each bucket a sorted file. A batch is ingested in two steps:
its postings are aggregated, which deals them into the same buckets, and
merge-anti-joined with every run's decided keys, bucket by bucket; the rest is
added as a run of level 0. The runs' side of these joins is neither shuffled nor sorted, so
a batch costs its own rows and one sequential read of the runs. Whenever a level holds `fanout` runs they are
merged, again bucket by bucket, into one run of the next level, so a key is rewritten once a level.

Batches are ranges of doc_id, largest first. A key that a run has counted in
`min_docs` documents is decided: later batches only have smaller ids, so
neither its fate nor the document that keeps it can change, and its further
postings need no room in the runs. The texts are read twice, to hash lines and to drop them, however many batches there are.

Defined results:
 - null or empty text: one empty line, kept;
 - null doc_id: such rows count as one document, smaller than all others;
 - rows that repeat a doc_id: one document for the counts, one row each in the result;
 - very long texts and lines: processed whole;
 - ties do not exist: the keeping document is the largest id, all its copies of the line stay;
 - an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import WHITESPACE, ascii_fold, discard, materialise, materialise_sorted, sorted_reads

#: Stands for a null doc_id inside the operator.
NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITESPACE))


def digest(line: Column) -> Column:
    """128 bits of the SHA-256 of a folded line, as hex: strings are told apart by a hash table, binary values pair by pair."""
    return F.substring(F.sha2(line.cast("binary"), 256), 1, 32)


def _id(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NO_ID))


def postings_of(docs: DataFrame, cuts: list[int], min_chars: int) -> DataFrame:
    """docs (doc_id, text) -> k, doc, batch: a row for each distinct long line of a row; batch 0 has the largest ids."""
    long_lines = F.filter(F.transform(lines_of(F.col("text")), stripped), lambda x: F.length(x) >= min_chars)
    keys = F.transform(F.transform(long_lines, ascii_fold), digest)
    doc = _id(F.col("doc_id"))
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (doc <= cut).cast("int")
    return docs.select(doc.alias("doc"), batch.alias("batch"), F.explode(F.array_distinct(keys)).alias("k")).select(F.unhex("k").alias("k"), "doc", "batch")


class LineRuns:
    """The levelled store; every run is a bucketed, sorted table in the shared folder."""

    KEYS = ("k",)

    def __init__(self, spark: SparkSession, min_docs: int = 5, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one: a full outer merge join, in which buckets of equal number meet in a task, so nothing is shuffled.

        A union would not do: Spark 4.1 takes a union of bucketed tables as dealt by their key, but sets their buckets side by side.
        """
        a, b = (r.select(*self.KEYS, F.col("n").alias(f"n{i}"), F.col("last").alias(f"l{i}")) for i, r in enumerate((a, b)))
        n = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
        return a.join(b.hint("merge"), list(self.KEYS), "full_outer").select(*self.KEYS, n.alias("n"), F.greatest("l0", "l1").alias("last"))

    def _merge(self, runs: list[DataFrame], label: str) -> DataFrame:
        """One run of several, written after each merge; the runs are deleted."""
        out = runs[0]
        for r in runs[1:]:
            with sorted_reads(self.spark):
                both = materialise_sorted(self.merged(out, r), label, self.KEYS, self.buckets)
            discard(out, r)
            out = both
        return out

    def undecided(self, postings: DataFrame) -> DataFrame:
        """What a batch adds: its keys with counts, merge-anti-joined with each run's decided keys."""
        run = postings.select(*self.KEYS, "doc").distinct().groupBy(*self.KEYS).agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        for held in self.runs():
            decided = held.where(F.col("n") >= self.min_docs).select(*self.KEYS)
            run = run.join(decided.hint("merge"), list(self.KEYS), "left_anti")
        return run

    def ingest(self, postings: DataFrame) -> None:
        """postings (k, doc) of a batch; its ids must all be smaller than those ingested before."""
        with sorted_reads(self.spark):
            self._add(materialise_sorted(self.undecided(postings), "run0", self.KEYS, self.buckets), 0)

    def _add(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._add(self._merge(full, f"run{level + 1}"), level + 1)

    def repeated(self) -> DataFrame:
        """(k, last) of the keys found in at least min_docs documents; all runs become one."""
        self.levels = [[self._merge(self.runs(), "all")]]
        return self.runs()[0].where(F.col("n") >= self.min_docs).select(*self.KEYS, "last")


def drop_repeated_lines(
    docs: DataFrame, *, batches: int = 4, min_docs: int = 5, min_chars: int = 40, fanout: int = 2
) -> DataFrame:
    """docs (doc_id, text, ...) -> struct column `row` of all its columns, `lines` and `kept` arrays of strings."""
    slim = docs.select("doc_id", "text")
    cuts = slim.agg(
        F.percentile_approx(_id(F.col("doc_id")), [i / batches for i in range(batches - 1, 0, -1)], 10000).alias("cuts")
    ).first()["cuts"]
    cuts = sorted(set(cuts or []), reverse=True)
    postings = materialise(postings_of(slim, cuts, min_chars), "postings", partition_by=("batch",))
    store = LineRuns(docs.sparkSession, min_docs, fanout)
    for batch in range(len(cuts) + 1):
        store.ingest(postings.where(F.col("batch") == batch))
    repeated = materialise(store.repeated(), "repeated")  # both sides of the join are then plain scans, split where skewed
    # (doc, digests): the keys that a document loses; documents that lose none have no row.
    drops = postings.join(repeated, "k").where(F.col("doc") != F.col("last"))
    drops = materialise(drops.groupBy("doc").agg(F.collect_set(F.lower(F.hex("k"))).alias("digests")), "drops")
    discard(postings, repeated, *store.runs())
    rows = docs.select(_id(docs["doc_id"]).alias("doc"), docs["text"].alias("text"), F.struct("*").alias("row"))
    # A merge join at every size: the shuffle then follows the input, whether or not the drops are few.
    split = rows.join(drops.hint("merge"), "doc", "left").select(
        "row", lines_of(F.col("text")).alias("lines"), F.coalesce("digests", F.array().cast("array<string>")).alias("digests")
    )

    def stays(line: Column) -> Column:
        return ~F.array_contains(F.col("digests"), digest(ascii_fold(stripped(line)))) | (
            F.length(stripped(line)) < min_chars
        )

    kept = F.when(F.size("digests") == 0, F.col("lines")).otherwise(F.filter("lines", stays))
    return split.select("row", "lines", kept.alias("kept"))


def without_repeated_lines(docs: DataFrame, **params) -> DataFrame:
    """docs with the repeated lines gone from text and n_chars, where there is one, set to its new length.

    A text that loses no line is left as it is, null included.
    """
    done = drop_repeated_lines(docs, **params)
    changed = F.size("kept") < F.size("lines")
    text = F.when(changed, F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    out = done.select("row", changed.alias("changed"), text.alias("text"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            n = F.when(F.col("changed"), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars"))
            cols.append(n.alias(c))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return out.select(*cols)
