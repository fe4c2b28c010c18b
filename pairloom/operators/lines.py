"""Line offsets and windows; lines end at a newline only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_table(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, line, start, length) per line. Only lengths are shuffled, one text per group."""
    lines = df.select(key, *keep, F.posexplode(F.transform(F.split(text, "\n"), lambda s: F.length(s))).alias("_at", "length"))
    before = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0))
    return lines.select(
        key, *keep, (F.col("_at") + 1).cast("bigint").alias("line"), start.cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length")
    )


def line_windows(lines: DataFrame, key: str, size: Column, *keep: str) -> DataFrame:
    """Windows of ``size`` lines clipped to the text; empty windows are dropped."""
    numbered = lines.withColumn("window", F.floor((F.col("line") - 1) / size).cast("bigint"))
    return (
        numbered.groupBy(key, *keep, "window")
        .agg(
            F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"),
            F.min("line").alias("start_line"), F.max("line").alias("end_line"),
        )
        .where(F.col("end") > F.col("start"))
    )


def context_windows(lines: DataFrame, key: str, anchor: Column, around: int) -> DataFrame:
    """The text range from ``around`` lines before the anchor line to as many after it."""
    near = F.col("line").between(anchor - around, anchor + around)
    return lines.where(near).groupBy(key).agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"),
        F.min("line").alias("start_line"), F.max("line").alias("end_line"),
    )
