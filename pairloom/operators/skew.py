"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import cut_lineage

# Upper bound on rows of every hot-key table, hence on every broadcast made from one.
MAX_HOT_KEYS = 20_000
HOT_ROWS = 100_000
# Keys that may be sent to every executor, at some 30 bytes each.
SENT_KEYS = 1_000_000


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``min_rows`` rows, the largest first, never more than MAX_HOT_KEYS."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("hot_rows"))
        .where(F.col("hot_rows") > min_rows)
        .orderBy(F.col("hot_rows").desc(), key)
        .limit(MAX_HOT_KEYS)
    )


def lookup_join(
    big: DataFrame, small: DataFrame, key: str, min_rows: int = HOT_ROWS, how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """Join many rows to a table with one row per key. ``hot`` may give the hot keys if they are known already.

    Rows of hot keys meet a broadcast of those keys' rows (bounded by MAX_HOT_KEYS) and are never
    shuffled by the hot key; the rest takes a shuffle join.
    """
    hot = (hot_keys(big, key, min_rows) if hot is None else hot.limit(MAX_HOT_KEYS)).select(F.col(key).alias("_hot"))
    tagged = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    hot_side = small.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_semi")
    heavy = tagged.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot_side), key, how)
    light = tagged.where(F.col("_hot").isNull()).drop("_hot").join(small, key, how)
    return heavy.unionByName(light)


def semi_join(big: DataFrame, keys: DataFrame, key: str, sent: int = SENT_KEYS) -> DataFrame:
    """Rows whose key is among those of ``keys``. A list of up to ``sent`` is broadcast, so that wide rows need no shuffle."""
    listed = cut_lineage(keys.select(key).where(F.col(key).isNotNull()).distinct())
    if listed.count() <= sent:
        return big.join(F.broadcast(listed), key, "left_semi")
    return big.join(listed.hint("merge"), key, "left_semi")


def blocked_self_join_sides(df: DataFrame, key: str, member: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Two sides of a self-join on ``key`` whose largest buckets are cut into blocks.

    A bucket of m rows becomes ceil(m / block_rows) blocks; every ordered pair of blocks has its own
    join key, so each pair of rows still meets exactly once and no task sees the whole bucket.
    """
    hot = hot_keys(df, key, block_rows).select(
        F.col(key).alias("_hot"), F.ceil(F.col("hot_rows") / F.lit(block_rows)).cast("int").alias("_blocks")
    )
    tagged = (
        df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        .withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
        .drop("_hot")
    )
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    left = tagged.withColumn("_other", F.explode(every)).withColumn("_cell", F.struct("_own", "_other"))
    right = tagged.withColumn("_other", F.explode(every)).withColumn(
        "_cell", F.struct(F.col("_other").alias("_own"), F.col("_own").alias("_other"))
    )
    drop = ("_blocks", "_own", "_other")
    return left.drop(*drop), right.drop(*drop)
