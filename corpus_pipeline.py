"""The corpus pipeline: its stages, in order, each over all that the one before kept.

It is part of the subpackage loamstone.llm and cannot be imported without it.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents. run()
writes what a stage returns to the shared folder and reads it for the next.

 toxicity: documents that the conditional random field calls toxic go;
 line_dedup: repeated lines go, except in the largest doc_id that holds them;
 near_dup: of documents linked by 5-word shingles at 0.8 or more, the smallest doc_id stays;
 decontaminate: documents that hold a window of a benchmark item go;
 mix: the documents that the mix takes words of, with their places in its shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm import decontaminate, line_dedup, mix, near_dup, toxicity
from loamstone.llm.common import materialise


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_near_duplicates(docs, words=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

#: SQL cannot express the conditional random field of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
