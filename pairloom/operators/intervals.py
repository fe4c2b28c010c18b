"""Joins of ranges: which ranges contain, meet or own which, by dyadic cells.

A half-open range [start, end) is cut into the fewest cells whose length is a power of two and whose place is a multiple
of it, at most two of each length; a point lies in one cell of each length. A range holds a point exactly if one of its
cells, and then only one, is among the point's, so the join is an equality of (group, level, cell) and meets each pair
once. Cells are no longer than 2^level: longer ranges are split into several, and so are the points under them, so that
neither a long range nor a group with many rows fills one key. Ranges are whole numbers (offsets, days, microseconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import MAX_HOT_KEYS
from pairloom.session import cut_lineage

# Rows of one group that may share the longest cells on average.
CELL_ROWS = 50_000


def _floor(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def longest_level(ranges: DataFrame, points: DataFrame, group: str, cell_rows: int = CELL_ROWS) -> int:
    """The level of the longest cells: that of the longest range, less where a group's points stand dense.

    ranges has start and end, points has the group and start. Only these figures reach the driver.
    """
    length = ranges.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1
    dense = points.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (F.max("start") - F.min("start") + 1).alias("span"))
    span = dense.agg(F.min(F.col("span") * cell_rows / F.col("n"))).first()[0] or length
    return max(0, min(int(length).bit_length() - 1, int(max(1, span)).bit_length() - 1))


def range_cells(start: Column, end: Column, level: int) -> Column:
    """The (level, cell) of a range: disjoint, together exactly the range; none for an empty one."""

    def of(k: Column) -> Column:
        low, high = -_floor(-start, k), _floor(end, k)
        left = F.when((low % 2 != 0) & (low < high), F.array(low)).otherwise(F.array().cast("array<bigint>"))
        right = F.when((high % 2 != 0) & (low < high), F.array(high - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.concat(left, right), lambda c: F.struct(k.alias("level"), c.alias("cell")))

    top = F.lit(level)
    low, high = -_floor(-start, top), _floor(end, top)
    whole = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    longest = F.transform(whole, lambda c: F.struct(top.alias("level"), c.alias("cell")))
    return F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(level - 1)), of)), longest) if level else longest


def point_cells(at: Column, level: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(level)), lambda k: F.struct(k.alias("level"), _floor(at, k).alias("cell")))


def stabbed(points: DataFrame, ranges: DataFrame, group: str, level: int) -> DataFrame:
    """Each pair of a row of points(group, start, end, ...) and a range(group, start, end, ...) that holds its start.

    Columns of the range come prefixed with ``r_``. A null group meets nothing.
    """
    outer = ranges.where(F.col("start") < F.col("end")).select(F.col(group).alias("_g"), F.explode(range_cells(F.col("start"), F.col("end"), level)).alias("_c"), *[F.col(c).alias(f"r_{c}") for c in ranges.columns if c != group])
    inner = points.select(*points.columns, F.explode(point_cells(F.col("start"), level)).alias("_c"))
    # Levels no range has are left out before the shuffle; there are at most 64.
    used = F.broadcast(outer.select(F.col("_c.level").alias("_l")).distinct())
    inner = inner.join(used, F.col("_c.level") == F.col("_l"), "left_semi")
    # Spark estimates the cells as no larger than the ranges they come from and would broadcast millions of them.
    return inner.join(outer.hint("merge"), (inner[group] == outer["_g"]) & (inner["_c"] == outer["_c"])).drop("_g", "_c")


def containing(inner: DataFrame, outer: DataFrame, group: str, level: int | None = None) -> DataFrame:
    """Pairs in which the range of outer contains that of inner: r_start <= start and end <= r_end."""
    depth = longest_level(outer, inner, group) if level is None else level
    return stabbed(inner, outer, group, depth).where(F.col("end") <= F.col("r_end"))


def overlapping_pairs(ranges: DataFrame, group: str, key: str, level: int | None = None) -> DataFrame:
    """(group, a, b) with a < b by key: ranges of one group with a common point, once each."""
    depth = longest_level(ranges, ranges, group) if level is None else level
    # Of two ranges that meet, one holds the other's start; where both begin together the smaller key counts as first.
    rows = stabbed(ranges, ranges, group, depth)
    first = (F.col("r_start") < F.col("start")) | ((F.col("r_start") == F.col("start")) & (F.col(f"r_{key}") < F.col(key)))
    met = rows.where(first & (F.col("start") < F.col("end")))
    return met.select(group, F.least(key, f"r_{key}").alias("a"), F.greatest(key, f"r_{key}").alias("b"))


def dense_levels(rows: DataFrame, group: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(_g, _level) of the groups that need shorter cells: those of more than cell_rows rows, never more than MAX_HOT_KEYS."""
    dense = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), (F.max("start") - F.min("start") + 1).alias("span")).where(F.col("n") > cell_rows)
    level = F.greatest(F.lit(0), F.floor(F.log2(F.col("span") * cell_rows / F.col("n"))).cast("int"))
    return dense.orderBy(F.col("n").desc(), group).limit(MAX_HOT_KEYS).select(F.col(group).alias("_g"), level.alias("_level"))


def owners(inner: DataFrame, outer: DataFrame, group: str, key: str, outer_key: str, density: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """(key, owners, innermost, outermost) of every row of inner: how many ranges of outer contain it, the shortest and
    the longest of them; ties go to the smaller outer key. Rows without an owner have 0 and nulls, as have rows without a
    key; rows of one key have the owners of all of them.

    Each row lies in one cell of its group, as long as the longest range, and meets the ranges that touch the cell; its
    owners are counted where they meet. Groups that stand dense in ``density`` (group and start; all rows if left out)
    have shorter cells. ``distinct`` says that inner has no key twice and none that is null, so nothing is put together
    afterwards.
    """
    length = F.col("r_end") - F.col("r_start")
    longest = outer.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    rows = inner.select(group, "start").unionByName(outer.select(group, "start")) if density is None else density
    levels = F.broadcast(cut_lineage(dense_levels(rows, group)))
    level = F.coalesce("_level", F.lit(max(0, int(longest)).bit_length()))
    points = inner.select(group, key, "start", "end").join(levels, F.col(group) == F.col("_g"), "left").select(group, key, "start", "end", _floor(F.col("start"), level).alias("_cell"))
    if not distinct:
        points = points.repartition(group, "_cell").groupBy(group, "_cell", key, "start", "end").agg(F.count(F.lit(1)).alias("_rows"))
    ranges = outer.where((F.col("start") < F.col("end")) & F.col(group).isNotNull()).join(levels, F.col(group) == F.col("_g"), "left")
    cells = F.sequence(_floor(F.col("start"), level), _floor(F.col("end") - 1, level))
    ranges = ranges.select(F.col(group).alias("_group"), F.explode(cells).alias("_c"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col(outer_key).alias("r_key"), F.lit(1).alias("_met"))
    holds = (F.col("r_start") <= F.col("start")) & (F.col("start") < F.col("r_end")) & (F.col("end") <= F.col("r_end"))
    met = points.join(ranges.hint("merge"), (F.col(group) == F.col("_group")) & (F.col("_cell") == F.col("_c")) & holds, "left")
    # Rows of one key and cell are in one task already.
    found = met.groupBy(*points.columns).agg(
        F.count("_met").alias("owners"), F.min(F.struct(length.alias("l"), F.col("r_key").alias("k"))).alias("i"), F.min(F.struct((-length).alias("l"), F.col("r_key").alias("k"))).alias("o")
    )
    if distinct:
        return found.select(key, "owners", F.col("i.k").alias("innermost"), F.col("o.k").alias("outermost"))
    owned = lambda c: F.min(F.when(F.col("owners") > 0, F.col(c))).alias(c)
    total = found.groupBy(key).agg(F.sum("_rows").alias("n"), F.sum(F.col("owners") * F.col("_rows")).alias("owners"), owned("i"), owned("o"))
    known = lambda c: F.when(F.col(key).isNotNull(), c)
    every = total.select(key, F.coalesce(known(F.col("owners")), F.lit(0)).alias("owners"), known(F.col("i.k")).alias("innermost"), known(F.col("o.k")).alias("outermost"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    return every.drop("col")


def outermost(ranges: DataFrame, group: str, key: str, level: int | None = None) -> DataFrame:
    """Ranges that no other of their group contains; of equal ranges the smallest key stays."""
    pairs = containing(ranges, ranges, group, level)
    same = (F.col("r_start") == F.col("start")) & (F.col("r_end") == F.col("end"))
    inside = pairs.where((F.col(f"r_{key}") != F.col(key)) & (~same | (F.col(f"r_{key}") < F.col(key)))).select(key).distinct()
    return ranges.join(inside, key, "left_anti")
