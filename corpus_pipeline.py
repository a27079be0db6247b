"""A corpus pipeline of five stages: identified language, one of each group of near duplicates, no benchmark passages, no
personal data, and sources mixed to their target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapwing.llm import decontaminate, jaccard, langid, mixing, pii
from lapwing.llm.scratch import Scratch, prepare


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose language has no chance of a half.  Learns from the labelled ones."""
    prepare(spark)
    return langid.keep_identified(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest number of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    prepare(spark)
    return jaccard.keep_one(docs, jaccard.Rule(width=5, percent=80))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to a fifth of its words edited."""
    prepare(spark)
    return decontaminate.drop_matching(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; all documents stay."""
    prepare(spark)
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources reach their target weights."""
    prepare(spark)
    return mixing.repeat_taken(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

# Trained models and edit distances have no SQL form; the tests compare what each stage keeps with brute force or held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again, so that a later stage doesn't repeat it."""
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
