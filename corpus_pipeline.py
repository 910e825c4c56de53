"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept, written as Parquet and read again in between.

* quality: trains on the labelled rows and drops texts that score under 0.7;
* near_duplicates: keeps one row, of the smallest id, of each component of
  texts linked by a Jaccard similarity of 0.8 or more on 5-word shingles;
* decontamination: drops documents that hold a benchmark passage;
* secrets: replaces every secret in a text by a mark (all rows stay);
* mixing: how many words of each document the weighted mix takes.

Defined cases: a null text is scored and compared as an empty one and stays
null; of texts without words all stay that quality keeps; repeated rows count
as copies, of which the near-duplicate stage keeps the first; null ids are
kept, after others; ties at the quality threshold stay; very long texts are
read whole; extra columns pass unchanged up to the last stage, which returns
its own; an empty table gives an empty result at every stage.  Texts go to
workers in batches of 2000 rows, set in the session, so that executors stay
within their memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholia.llm import decontaminate, jaccard, mixing, quality, secret_scan
from scholia.llm.store import keep, small_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_quality(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.one_per_component(docs, words=5, percent=80).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted classifier, fingerprints and pseudorandom draws: SQL cannot express the stages.
ORACLE_SQL = None
