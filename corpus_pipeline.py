"""A training corpus from ``documents``: toxicity filter, exact and near
deduplication, benchmark decontamination, token ids.

Every stage works on all rows that its predecessor kept. The first four return the
columns of ``documents``; the last returns doc_id, n_tokens, ids, ids_sha256 and
decoded_sha256 of the documents that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crmlake.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from crmlake.llm.common import documents, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model is trained on the labelled rows of ``docs``."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, one stays."""
    return exact_dedup.keep_first(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the smallest id stays."""
    return ngram_join.keep_first(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, documents(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, and a check of their decoding."""
    return bpe.digest(bpe.bpe_round_trip(docs))


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_dedup_stage), ("ngram_join", ngram_join_stage),
          ("decontamination", decontamination_stage), ("bpe", bpe_stage)]

# model scores, near duplicates and merges have no SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
