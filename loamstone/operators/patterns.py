"""Which of many patterns a text contains first: Aho-Corasick automata, each text read once for each of them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns in one automaton. Its states take some sixty times that, in every worker.
PART_BYTES = 2 << 20


def first_matches(texts: DataFrame, patterns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """texts (text), distinct, and patterns (pattern, ord) -> text, ord: the least ord of the patterns that the lower-cased text contains.

    Texts without a match are left out, as are null texts; a null pattern or ord matches nothing and an empty pattern everything.
    The patterns are dealt by hash to parts of bounded size. A part is compiled once and broadcast; its automaton finds
    all occurrences in one pass over a text, however many patterns there are. The texts are read once a part.
    """
    spark = texts.sparkSession
    known = patterns.where("pattern IS NOT NULL AND ord IS NOT NULL").groupBy("pattern").agg(F.min(F.col("ord").cast("long")).alias("ord"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("pattern") + 1), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    lowered = texts.where("text IS NOT NULL").select("text", F.lower("text").alias("lowered"))
    found = spark.createDataFrame([], "text string, ord long")
    for part in range(parts):
        rows = known.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part).collect()
        found = found.unionByName(_matched(lowered, [(r["pattern"], r["ord"]) for r in rows]))
    return found.groupBy("text").agg(F.min("ord").alias("ord"))


def _matched(lowered: DataFrame, part: list[tuple[str, int]]) -> DataFrame:
    """lowered (text, lowered) -> text, ord for one part."""
    automaton, always = ahocorasick.Automaton(), min((o for p, o in part if not p), default=None)
    for pattern, ord_ in part:
        if pattern:
            automaton.add_word(pattern, ord_)
    some = len(automaton) > 0
    if some:
        automaton.make_automaton()
    compiled = lowered.sparkSession.sparkContext.broadcast(automaton if some else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, orders = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = (o for _, o in compiled.value.iter(text)) if some else ()
                best = min(hits, default=None)
                if always is not None:
                    best = always if best is None else min(best, always)
                if best is not None:
                    texts.append(i)
                    orders.append(best)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts, pa.int64())), pa.array(orders, pa.int64())], ["text", "ord"])

    return lowered.mapInArrow(run, "text string, ord long")
