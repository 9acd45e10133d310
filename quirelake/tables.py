"""Reading of the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of `sf_dir`."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
