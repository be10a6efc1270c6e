"""Reading the Parquet tables that every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; works for any path Spark itself can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
