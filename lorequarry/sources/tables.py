"""Readers for the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
