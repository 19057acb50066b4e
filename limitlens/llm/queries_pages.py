"""Queries over pages: URL filter and web archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limitlens.llm import url_filter, web_archive


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return web_archive.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_warc": op5_warc, "op8_url_filters": op8_url_filters}
SQL: dict[str, str] = {}
