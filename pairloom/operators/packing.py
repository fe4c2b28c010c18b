"""Bounded context, trimming, question groups, window sizes and pack sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.operators.ordered import first_n, merge_intervals


def bounded_references(refs: DataFrame, unit: str, order_by: list, cap: int, reason: str) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` references per unit, and an omission row counting the rest."""
    kept = first_n(refs, [unit], order_by, cap)
    counts = refs.groupBy(unit).agg((F.count(F.lit(1)) - cap).alias("count")).where(F.col("count") > 0)
    return kept, counts.select(unit, F.lit(reason).alias("reason"), "count", F.lit(False).alias("decisive"))


def best_test_reference(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """One row per (member, test path): calls of the member before imports of its file, then by place.

    Both inputs have member, test_path and place; the choice is a combinable minimum.
    """
    every = calls.withColumn("priority", F.lit(0)).unionByName(imports.withColumn("priority", F.lit(1)))
    return every.groupBy("member", "test_path").agg(F.min(F.struct("priority", "place")).alias("best")).select(
        "member", "test_path", F.col("best.priority").cast("bigint").alias("priority"), F.col("best.place").alias("place")
    )


def trim_to_budget(refs: DataFrame, unit: str, order_by: list, size: str, base: Column, budget: int) -> DataFrame:
    """Drop references in trim order until what is left fits; dropped ones are marked, never removed.

    A unit has at most thirteen references (three callers, eight declarations, two tests), so the window
    per unit is small.
    """
    order = Window.partitionBy(unit).orderBy(*order_by)
    whole = Window.partitionBy(unit)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = base + F.sum(size).over(whole) - before
    return refs.withColumn("_left", left).withColumn(
        "omission", F.when(F.col("_left") > budget, F.lit("request_byte_budget_trim"))
    ).drop("_left")


def question_groups(df: DataFrame, questions: str, base: Column, cap: int) -> DataFrame:
    """Next-fit groups of questions in catalog order under a byte cap.

    ``questions`` is an array of struct(position, bytes), at most nine long. Adds ``groups``, the group
    number per question, null when one question alone exceeds the cap.
    """
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc, q):
        fits = (base + acc["used"] + q["bytes"] <= cap) | (F.size(acc["out"]) == 0)
        group = F.when(fits, acc["group"]).otherwise(acc["group"] + 1)
        used = F.when(fits, acc["used"] + q["bytes"]).otherwise(q["bytes"])
        return F.struct(group.alias("group"), used.alias("used"), F.concat(acc["out"], F.array(group)).alias("out"))

    folded = F.aggregate(F.col(questions), start, step)["out"]
    too_large = F.exists(F.col(questions), lambda q: base + q["bytes"] > cap)
    return df.withColumn("groups", F.when(~too_large, folded))


def window_sizes(lines: Column) -> Column:
    """Half the lines, then halves of that, down to the smallest window."""
    start = F.greatest(F.lit(K.MIN_WINDOW_LINES), F.ceil(lines / 2).cast("int"))
    ladder = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.greatest(F.lit(K.MIN_WINDOW_LINES), F.floor(start / F.pow(F.lit(2.0), k)).cast("int")))
    return F.array_distinct(ladder)


def choose_window(line_rows: DataFrame, key: str, total: str, cap: int) -> DataFrame:
    """Largest window size of the ladder whose windows all fit the cap, else the smallest size.

    ``line_rows`` has key, line, length and the number of lines in ``total``. All sizes are tried at once;
    sums per window are combined before the shuffle.
    """
    tried = line_rows.withColumn("size", F.explode(window_sizes(F.col(total))))
    windows = tried.groupBy(key, "size", F.floor((F.col("line") - 1) / F.col("size")).alias("_w")).agg(F.sum(F.col("length") + 1).alias("bytes"))
    per_size = windows.groupBy(key, "size").agg(F.max("bytes").alias("largest"), F.count(F.lit(1)).alias("windows"))
    ok = (F.col("largest") <= cap) | (F.col("size") == K.MIN_WINDOW_LINES)
    best = per_size.where(ok).groupBy(key).agg(F.max_by(F.struct("size", "windows", "largest"), "size").alias("b"))
    return best.select(key, F.col("b.size").cast("bigint").alias("size"), F.col("b.windows").alias("windows"), F.col("b.largest").alias("largest"))


def pack_sections(ranges: DataFrame, unit: str) -> DataFrame:
    """Merged text ranges per unit with the roles they serve in order of first sight.

    ``ranges`` has unit, role, start and end.
    """
    rows = merge_intervals(ranges, [unit], "start", "end", ["role"])
    roles = rows.groupBy(unit, "island", "role").agg(F.min("start").alias("first"), F.min("start").alias("start"), F.max("end").alias("end"))
    # Roles are a handful per unit.
    return roles.groupBy(unit, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("first", "role"))).alias("r")
    ).select(unit, F.col("island").cast("bigint").alias("section"), "start", "end", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))
