"""Training-corpus pipeline over ``documents``: five stages, each written as Parquet and reread by the next.

1. toxicity: documents that the field scores as toxic go;
2. line_dedup: records that recur in other documents lose all copies but the first;
3. near_dedup: one document of each near-duplicate group stays (the smallest id);
4. decontaminate: documents in which a benchmark item leaks go;
5. sentencepiece: every text is encoded and decoded.

A stage whose input misses a column of ``documents`` fails; other columns are carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.functions.storage import materialize
from lattica.llm import decontaminate, line_dedup, simhash, toxicity, wordpieces


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, made)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wordpieces.piece_round_trip(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("sentencepiece", stage_sentencepiece),
]

#: SQL cannot express a fitted field, pigeonring components or a tokenizer; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
