"""The training-data pipeline: quality rules, toxicity, near duplicates, secrets, packing, in this order.

Each stage takes what its predecessor kept and returns the columns of `documents`; the last returns where each kept
document lies in the packed bins. Belongs to subpackage llm.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import fertility, jaccard, packing, secrets, toxicity
from quillspark.llm.common import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tokenisers' fertility and the base rules keep."""
    return fertility.filter_quality(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learnt from the labels beside the table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.filter_toxic(docs, toxicity.fit_from(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a Jaccard similarity of 0.8 on five words, the one with the smallest id."""
    return jaccard.keep_one(docs, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return packing.pack(docs, "doc_id", F.octet_length("text"), F.col("source"), packing.text_cluster(F.col("text")))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", best_fit_packing),
]

#: Fitted models and tokenisers are not SQL; tests hold the operators and the near-duplicate stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next; a table goes when its
    successor is written."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    before = None
    for name, stage in STAGES[:-1]:
        docs = space.put(stage(spark, docs, sf_dir), name)
        if before:
            space.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
