"""Line numbers of text files that are read in splits.

Spark reads a large file as byte ranges, each by another task, so a row doesn't know its line. Within a range rows keep
their order and every range knows where it begins: the ranges' line counts, summed over the ranges before, give
the first line of each. Only counts are shuffled, one row a range; no file is read by one task because of its numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, entry, value) of every line that isn't blank: its number among all lines of its file and among
    those that aren't blank, both from 1."""
    own = F.col("_metadata")
    read = spark.read.text(path).select(own["file_path"].alias("file"), own["file_block_start"].alias("block"), "value", F.monotonically_increasing_id().alias("a"))
    written = F.length(F.trim(F.regexp_replace("value", r"\s+", " "))) > 0
    entries = read.where(written).withColumn("b", F.monotonically_increasing_id())
    # A range's rows are neighbours in their task, so a row's place is its distance from the first one.
    lines = read.groupBy("file", "block").agg(F.min("a").alias("a0"), F.count(F.lit(1)).alias("n"), F.count_if(written).alias("m"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.select("file", "block", "a0", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "m")])
    starts = starts.join(entries.groupBy("file", "block").agg(F.min("b").alias("b0")), ["file", "block"])
    return entries.join(starts, ["file", "block"]).select(
        "file", (F.col("n0") + F.col("a") - F.col("a0") + 1).alias("line"), (F.col("m0") + F.col("b") - F.col("b0") + 1).alias("entry"), "value"
    )


def parsed_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the JSON objects of the files' lines with file and line, and the lines that are none."""
    record = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = numbered_lines(spark, path).withColumn("r", record)
    torn = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    return rows.where(~torn).select("file", "line", "r.*").drop("_corrupt_record"), rows.where(torn).select("file", "line", "entry", "value")
