"""Admit-or-skip budgets over an ordered list, without one task folding the whole list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordered import running
from pairloom.session import cut_lineage


def admit_in_order(df: DataFrame, order_by: list, size: str, total: int, count: int | None = None, each: int | None = None) -> DataFrame:
    """Take rows in order while they fit; a row that does not fit is skipped and later ones may still fit.

    Each round admits the longest prefix that fits, by a distributed running sum, then drops the rows too
    large for what is left: the budget only shrinks, so they can never be admitted. The driver keeps two
    numbers. Adds ``admitted``.
    """
    key = [c for c in order_by]
    left_total, left_count = total, count
    base = cut_lineage(df)
    rest = base if each is None else base.where(F.col(size) <= each)
    taken = []
    while True:
        fits = F.col(size) <= left_total
        state = cut_lineage(running(rest.where(fits), [], key, sums={"_sum": F.col(size), "_n": F.lit(1).cast("bigint")}))
        inside = F.col("_sum") <= left_total
        if left_count is not None:
            inside = inside & (F.col("_n") <= left_count)
        admitted = state.where(inside)
        got = admitted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("s")).first()
        if not got["n"]:
            break
        taken.append(admitted.drop("_sum", "_n"))
        left_total -= got["s"]
        if left_count is not None:
            left_count -= got["n"]
            if left_count == 0:
                break
        rest = state.where(~inside).drop("_sum", "_n")
    if not taken:
        return base.withColumn("admitted", F.lit(False))
    chosen = reduce(DataFrame.unionByName, taken).select(*key).withColumn("_in", F.lit(True))
    return base.join(chosen, key, "left").withColumn("admitted", F.coalesce("_in", F.lit(False))).drop("_in")
