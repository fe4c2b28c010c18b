"""Connected components of an edge table by alternating large-star and small-star rounds.

Ids may be of any type with an order. A round costs two combinable minima a node and two joins of edges to them, all
written to the checkpoint folder, so that each join has plain shuffled sides which Spark splits where a hub holds
many edges. The number of rounds grows with the logarithm of the longest path; rounds go on until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import cut, discard


def _only_stars(edges: DataFrame) -> bool:
    ends = edges.groupBy(F.col("u").alias("n")).agg(F.count(F.lit(1)).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).cast("long").alias("out"), F.lit(1).alias("into")).distinct()
    )
    both = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return both.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to ``(member, component)``: each node with an edge to another, and its smallest reachable node.

    Null ends and loops are no edges; repeated edges count once; an empty table gives no rows.
    """
    current = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _only_stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = cut(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(current, low, large, least)
        current = following
    pairs = current.select(F.col("u").alias("member"), F.col("v").alias("component"))
    return pairs.unionByName(current.select(F.col("v").alias("member"), F.col("v").alias("component")).distinct())
