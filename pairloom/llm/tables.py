"""Reading input tables and naming columns for the operators."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared checkpoint folder and read again.

    Unlike after checkpoint(), Spark knows the table's true size. A checkpoint keeps the estimate of its plan, which for
    a join is the product of both sides', so that over rounds of joins it grows beyond all bounds.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = posixpath.join(spark.sparkContext.getCheckpointDir(), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables made by cut() that nothing reads any more."""
    for table in tables:
        if path := table.__dict__.get("_cut_path"):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators need, so other columns never clash with theirs."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of all learning: crc32 of the id's text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# Ids that may be sent to every executor: 16 MB of longs. More are joined by a shuffle.
SENT_IDS = 1_000_000


def split_by_ids(rows: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is (left_semi) or isn't (left_anti) in the first column of ids; a null id is in none.

    The ids are written to the checkpoint folder and counted: a short list is broadcast, so that texts needn't be
    shuffled; a longer one takes a shuffle join.
    """
    key = cut(ids.select(F.col(ids.columns[0]).cast("long").alias("_split_id")).where("_split_id is not null").distinct())
    sent = F.broadcast(key) if key.count() <= SENT_IDS else key
    return rows.join(sent, F.col(id_col).cast("long") == F.col("_split_id"), how)


def one_row_per_id(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of rows that share an id, the least by all columns; rows without id stay. Only rows of such ids are grouped."""
    twice = cut(rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col))
    if twice.isEmpty():
        return rows
    order = [id_col, *(c for c in rows.columns if c != id_col)]
    least = split_by_ids(rows, twice, "left_semi", id_col).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.struct(*order)).alias("_r"))
    return split_by_ids(rows, twice, "left_anti", id_col).unionByName(least.select("_r.*").select(*rows.columns))
