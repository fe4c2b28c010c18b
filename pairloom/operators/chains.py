"""Chains of references followed to their end by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import lookup_join
from pairloom.session import written


def follow_chains(nodes: DataFrame) -> DataFrame:
    """(name, end, steps, state) of every row of ``nodes(name, next)``; names are distinct and not null.

    A node without a next one is an end. state is ``ended``; ``missing`` if the chain leaves the table, end being the name
    that isn't there; or ``cycle``, where end and steps are null. Each round doubles how far an open pointer reaches, so a
    chain of m steps takes log2(m) rounds; pointers still open once they reach farther than there are nodes run in
    cycles. Only open pointers are joined, never a null key, and a name that many point to is served from a broadcast.
    """
    state = written(nodes.select("name", F.coalesce("next", "name").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.col("next").isNotNull().alias("open")))
    n, reach = state.count(), 1
    while True:
        going = state.where("open")
        if going.isEmpty():
            break
        if reach > n:
            break
        target = state.select(F.col("name").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        moved = written(lookup_join(going.select("name", "at", "steps"), target, "at", how="left"))
        gone = moved.where(F.col("_at").isNull())
        # Whoever points at a node that leaves the table leaves it too: such nodes are ends under a name not their own.
        lost = gone.select("name", "at", "steps", F.lit(False).alias("open"))
        ahead = moved.where(F.col("_at").isNotNull()).select("name", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open"))
        state = written(state.where(~F.col("open")).unionByName(lost).unionByName(ahead))
        reach *= 2
    known = state.where(~F.col("open"))
    ends = nodes.where(F.col("next").isNull()).select(F.col("name").alias("at"), F.lit(True).alias("_end"))
    settled = lookup_join(known, ends, "at", how="left").select("name", F.col("at").alias("end"), "steps", F.when(F.col("_end"), "ended").otherwise("missing").alias("state"))
    looping = state.where("open").select("name", F.lit(None).cast(nodes.schema["name"].dataType).alias("end"), F.lit(None).cast("bigint").alias("steps"), F.lit("cycle").alias("state"))
    return settled.unionByName(looping)
