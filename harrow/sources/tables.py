"""Landed tables: parquet readers with the type fixes every operator relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one landed table.

    Zone-less parquet timestamps arrive as TIMESTAMP_NTZ; the reference treats
    naive times as UTC, so they are cast to session-UTC timestamps here, once.
    Column pruning and filter pushdown still reach the parquet scan because the
    cast is a plain projection.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        # every timestamp rule here reads naive times as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    casts = [
        F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, TimestampNTZType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return over_cores(df.select(*casts))


def over_cores(df: DataFrame) -> DataFrame:
    """On one machine (``local[...]``) deal the rows out over its cores; on a cluster the scan's own splits stay.

    A file with a single row group scans as one task, which would run all
    per-row work on one core.
    """
    context = df.sparkSession.sparkContext
    return df.repartition(context.defaultParallelism) if context.master.startswith("local[") else df


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the landed tables as temp views (used by the derived fixture views)."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
