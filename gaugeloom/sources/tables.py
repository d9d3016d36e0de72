"""Readers for the Parquet tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` under `root`, a path that any Spark file system can open."""
    return spark.read.parquet(f"{root}/{name}.parquet")
