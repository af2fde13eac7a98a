"""Access to the parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
