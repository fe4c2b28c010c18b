"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table. A text table read by fewer tasks than there are cores is spread over them first."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if name in TEXT_TABLES:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
    return df
