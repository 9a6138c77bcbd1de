"""Readers for the parquet tables and a session factory.

Reads are plain ``spark.read.parquet``: Catalyst prunes columns and pushes
filters into the scan, so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by hash to at least the session's parallelism if its scan has fewer
    splits (a small file is one split and would keep one core busy); otherwise as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *by)


def deal_rows(df: DataFrame, rows: int, per_task: int, *by) -> DataFrame:
    """``df`` of some ``rows`` rows dealt by hash to tasks of about ``per_task`` rows, at least the
    session's parallelism: tasks keep their size as the table grows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(n, -(-rows // per_task)), *by)


def documents(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """The ``documents`` table; ``lang`` is pushed down to the scan."""
    df = read_table(spark, sf_dir, "documents")
    if lang is not None:
        df = df.where(df["lang"] == lang)
    return spread(df, "doc_id")
