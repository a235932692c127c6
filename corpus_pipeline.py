"""A training-data pipeline: each stage is one of the corpus operators.

Stages read the previous stage's Parquet output, written under the shared folder
of spark.checkpoint.dir. Rules that reject a document drop it and its failing lines;
one document of each group of near duplicates stays; live-looking secrets
are masked; the mix repeats or leaves out documents by their source's target; packing
returns the pieces with their places.

Defined cases: null and empty texts fail the quality rules and go; a near-duplicate group keeps its smallest
doc_id, nulls last, ties by a hash of the text; rows equal in doc_id and text count once there; a null owner or source is
one of that name; an empty table gives no pieces. Columns that the stages do not read pass through to packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from survspan.llm import jaccard_join, mixing, packing, quality_rules, secret_scan
from survspan.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_live(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scan", secret_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

# Packing by a tokenizer's ids cannot be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
