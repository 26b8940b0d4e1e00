"""Parquet tables by name under one folder, wherever Spark can read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`; a scan, so filters and columns are pushed into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
