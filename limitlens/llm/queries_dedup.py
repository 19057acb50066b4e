"""Queries of the n-gram join and of packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limitlens.llm.ngram_join import ngram_components
from limitlens.llm.packing import pack


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every sequence of every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join, "op2_packing": op2_packing}
SQL: dict[str, str] = {}
