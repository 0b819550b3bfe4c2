"""Landed pages (S5): hits joined to their page, one page per URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_pages(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed page rows (url, final_url, status_code, html) from parquet or JSON lines."""
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.schema("url string, final_url string, status_code int, html string")
    return reader.load(path)


def join_pages(hits: DataFrame, pages: DataFrame, order: str | None = None) -> DataFrame:
    """Left join hits to landed pages on the raw URL; hits without a page keep
    NULL page columns (they fall back to search-only extraction).  Of pages
    landed twice the first by ``order`` counts."""
    row = F.struct("final_url", "status_code")
    first = F.min_by(row, order) if order else F.min(row)
    p = pages.groupBy("url").agg(first.alias("__page")).select("url", "__page.*").withColumn("has_page", F.lit(True))
    return (hits.join(p, "url", "left")
                .withColumn("has_page", F.coalesce(F.col("has_page"), F.lit(False))))
