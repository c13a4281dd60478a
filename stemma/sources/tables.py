"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; columns and filters go down to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
