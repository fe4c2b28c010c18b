"""Order-dependent operators that never put a whole group in one task.

A plain ``sum() OVER (PARTITION BY g ORDER BY k)`` sends all rows of ``g`` to one task. Here rows are
range-partitioned on (group, order), each slice is scanned on its own, and what earlier slices of the
same group contribute is added afterwards. Only the first group of a slice can have begun in an earlier
slice, so the carry table has fewer rows than there are slices and its broadcast is bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import cut_lineage, slice_count

SLICE = "_slice"


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slice_by_order(df: DataFrame, partition_by: list[str], order_by: list) -> DataFrame:
    """Range-partition on a total order and pin each row's slice number."""
    parts = slice_count(df.sparkSession)
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in partition_by], *map(_column, order_by))
    # The slice bounds are sampled, so they are pinned before two queries read them.
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))


def running(
    df: DataFrame,
    partition_by: list[str],
    order_by: list,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    exclusive: bool = False,
    sliced: bool = False,
    keep_slice: bool = False,
) -> DataFrame:
    """Running sums and maxima per group. ``order_by`` must be total within a group.

    ``exclusive`` leaves the current row out. ``sliced`` says that ``df`` already carries slices made
    by ``slice_by_order`` on the same order.
    """
    sums, maxes = sums or {}, maxes or {}
    base = df if sliced else slice_by_order(df, partition_by, order_by)
    end = -1 if exclusive else Window.currentRow
    inside = (
        Window.partitionBy(SLICE, *partition_by)
        .orderBy(*map(_column, order_by))
        .rowsBetween(Window.unboundedPreceding, end)
    )
    local = base.select(
        "*",
        *[F.sum(c).over(inside).alias(n) for n, c in sums.items()],
        *[F.max(c).over(inside).alias(n) for n, c in maxes.items()],
    )
    earlier = (
        Window.partitionBy(*[F.col(f"_k_{c}") for c in partition_by])
        .orderBy("_k_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        base.groupBy(F.col(SLICE).alias("_k_slice"), *[F.col(c).alias(f"_k_{c}") for c in partition_by])
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(c).alias(f"_c_{n}") for n, c in sums.items()],
            *[F.max(c).alias(f"_c_{n}") for n, c in maxes.items()],
        )
        .select(
            "_k_slice",
            *[f"_k_{c}" for c in partition_by],
            F.sum("_rows").over(earlier).alias("_rows"),
            *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
            *[F.max(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in maxes],
        )
        .where(F.col("_rows").isNotNull())
        .drop("_rows")
    )
    match = reduce(
        lambda acc, c: acc & F.col(c).eqNullSafe(F.col(f"_k_{c}")),
        partition_by,
        F.col(SLICE) == F.col("_k_slice"),
    )
    joined = local.join(F.broadcast(carry), match, "left")
    keep = df.columns if sliced else df.columns + ([SLICE] if keep_slice else [])
    if sliced and not keep_slice:
        keep = [c for c in keep if c != SLICE]
    return joined.select(
        *keep,
        *[(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(F.col(n), F.col(f"_c_{n}")).alias(n) for n in maxes],
    )


def ranked(df: DataFrame, partition_by: list[str], order_by: list, name: str = "rank") -> DataFrame:
    """``row_number`` for groups of any size, a single global group included."""
    return running(df, partition_by, order_by, sums={name: F.lit(1).cast("bigint")})


def first_n(df: DataFrame, partition_by: list[str], order_by: list, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows per group.

    Spark cuts each map task to ``n`` rows per group before the shuffle (window group limit), so a hot
    group costs at most ``n`` rows per map task.
    """
    window = Window.partitionBy(*partition_by).orderBy(*map(_column, order_by))
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str, tie: list[str]) -> DataFrame:
    """Label overlapping or touching intervals per key with an island number."""
    order = [start, end, *tie]
    base = slice_by_order(df, key, order)
    seen = running(base, key, order, maxes={"_reach": F.col(end)}, exclusive=True, sliced=True, keep_slice=True)
    flagged = seen.withColumn(
        "_opens", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
    )
    return running(flagged, key, order, sums={"island": F.col("_opens")}, sliced=True).drop("_reach", "_opens")
