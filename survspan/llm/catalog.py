"""Registered queries of the corpus operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (
    byte_bpe,
    collocations,
    exact_topk,
    hard_negatives,
    jaccard_join,
    license_scan,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    suffix_dedup,
)
from .common import documents


def _on_documents(op: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: op(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _on_documents(quality_rules.op1_quality_rules),
        "op2_sharding": _on_documents(sharding.op2_sharding),
        "op3_jaccard_join": _on_documents(jaccard_join.op3_jaccard_join),
        "op4_license_scan": _on_documents(license_scan.op4_license_scan),
        "op5_mixing": _on_documents(mixing.op5_mixing),
        "op6_exact_topk": lambda spark, sf_dir: exact_topk.op6_exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op7_packing": _on_documents(packing.op7_packing),
        "op8_secret_scan": _on_documents(secret_scan.op8_secret_scan),
        "op9_suffix_dedup": _on_documents(suffix_dedup.op9_suffix_dedup),
        "op10_quality_classifier": lambda spark, sf_dir: quality_classifier.op10_quality_classifier(
            documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op11_collocations": _on_documents(collocations.op11_collocations),
        "op12_hard_negatives": lambda spark, sf_dir: hard_negatives.op12_hard_negatives(
            spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op13_byte_bpe": _on_documents(byte_bpe.op13_byte_bpe),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE_SQL,
        "op5_mixing": mixing.ORACLE_SQL,
        "op6_exact_topk": exact_topk.ORACLE_SQL,
        "op11_collocations": collocations.ORACLE_SQL,
        "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    }
