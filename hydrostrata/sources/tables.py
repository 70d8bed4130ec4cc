"""Parquet table access. Column pruning and filters are left to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
