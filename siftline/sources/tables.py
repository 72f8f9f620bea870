"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of `folder`; a file or a folder of part files, filters and columns reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
