"""Stored HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """`(page_id, url, html)`; a term or fetch time stays if the table has one."""
    pages = spark.read.parquet(path)
    extra = [name for name in ("term", "fetched_at") if name in pages.columns]
    return pages.select("page_id", "url", "html", *extra)
