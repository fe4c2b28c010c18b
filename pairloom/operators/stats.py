"""Ranking and agreement statistics over groups of any size.

Scores are first reduced to one row per (group, score), which map tasks combine; only that histogram is
ordered. Counts stay integers until the last division, so results do not depend on row order.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pairloom import constants as K
from pairloom.functions import measures as M
from pairloom.operators.ordered import ranked, running
from pairloom.session import cut_lineage, slice_count

WHOLE = "decimal(38,0)"

# Functions that run in tasks are pickled by value, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Resamples that one task row draws, draws made at a time, and items whose cells travel as one array.
REPLICATES_AT_ONCE = 50
STRETCH = 1 << 16
BLOCK_ITEMS = 1 << 18


def _histogram(df: DataFrame, keys: list[str], score: str, label: str, weight: Column | None) -> DataFrame:
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, F.col(score).alias("_s"))
        .agg(
            F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("_pos"),
            F.sum(F.when(F.col(label) != 1, w).otherwise(0)).alias("_neg"),
        )
    )


def auc(df: DataFrame, keys: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """Chance that a positive outscores a negative, ties one half; null with one class."""
    hist = running(_histogram(df, keys, score, label, weight), keys, ["_s"], sums={"_below": F.col("_neg")})
    wins = F.col("_pos").cast("decimal(18,0)") * ((F.col("_below") - F.col("_neg")) * 2 + F.col("_neg")).cast("decimal(19,0)")
    grouped = hist.groupBy(*keys).agg(
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"), F.sum(wins.cast(WHOLE)).alias("_wins")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    value = F.when(pairs > 0, F.col("_wins").cast("double") / (pairs * F.lit(2.0)))
    return grouped.select(*keys, "positives", "negatives", value.alias("auc"))


def precision_at_k(df: DataFrame, keys: list[str], score: str, label: str, k: DataFrame) -> DataFrame:
    """Precision of the best ``k`` rows, rows tied at the edge sharing the slots left; null for k = 0.

    ``k`` holds one row per group with column ``k``.
    """
    hist = _histogram(df, keys, score, label, None).withColumn("_n", F.col("_pos") + F.col("_neg"))
    top = running(hist, keys, [F.col("_s").desc()], sums={"_cum": F.col("_n"), "_hits": F.col("_pos")})
    joined = top.join(k, keys)
    before = F.col("_cum") - F.col("_n")
    edge = joined.where((before < F.col("k")) & (F.col("k") <= F.col("_cum")))
    hits = (F.col("_hits") - F.col("_pos")).cast("double") + ((F.col("k") - before) * F.col("_pos")).cast("double") / F.col("_n")
    return edge.select(*keys, "k", (hits / F.col("k")).alias("precision"))


def confusion(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    return df.groupBy(*keys, first, second).agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Agreement beyond chance of two label columns."""
    table = confusion(df, keys, first, second)
    sides = table.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(first).alias("label"), F.col("n").alias("row"), F.lit(0).cast("bigint").alias("col"),
                         F.when(F.col(first) == F.col(second), F.col("n")).otherwise(0).alias("agree")),
                F.struct(F.col(second).alias("label"), F.lit(0).cast("bigint").alias("row"), F.col("n").alias("col"),
                         F.lit(0).cast("bigint").alias("agree")),
            )
        ).alias("x"),
    ).select(*keys, "x.*")
    margins = sides.groupBy(*keys, "label").agg(
        F.sum("row").alias("row"), F.sum("col").alias("col"), F.sum("agree").alias("agree")
    )
    product = (F.col("row").cast("decimal(18,0)") * F.col("col").cast("decimal(18,0)")).cast(WHOLE)
    total = margins.groupBy(*keys).agg(
        F.sum("row").alias("n"), F.sum("agree").alias("agree"), F.sum(product).alias("_product")
    )
    n = F.col("n").cast("double")
    observed, expected = F.col("agree") / n, F.col("_product").cast("double") / (n * n)
    kappa = F.when(expected == 1, F.lit(1.0)).otherwise((observed - expected) / (F.lit(1.0) - expected))
    return total.select(*keys, "n", "agree", observed.alias("agreement"), kappa.alias("kappa"))


def binary_metrics(df: DataFrame, keys: list[str], fired: Column, positive: Column) -> DataFrame:
    """Counts, rates with Wilson intervals, and the majority baseline per group."""
    def count(c):
        return F.count_if(c).cast("bigint")

    out = df.groupBy(*keys).agg(
        count(fired & positive).alias("tp"), count(fired & ~positive).alias("fp"),
        count(~fired & ~positive).alias("tn"), count(~fired & positive).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    rates = {"recall": (tp, tp + fn), "false_positive_rate": (fp, tn + fp), "precision": (tp, tp + fp), "accuracy": (tp + tn, n)}
    columns = []
    for name, (k, of) in rates.items():
        low, high = M.wilson(k, of)
        columns += [M.rate(k, of).alias(name), low.alias(f"{name}_lo"), high.alias(f"{name}_hi")]
    return out.select(
        *keys, "tp", "fp", "tn", "fn", *columns,
        M.rate(F.greatest(tp + fn, tn + fp), n).alias("majority_baseline"), M.noise_floor(n).alias("noise_floor"),
    )


def sign_test(df: DataFrame, keys: list[str], higher: str, lower: str) -> DataFrame:
    """Two-sided exact sign test per row: the sum of binomial masses not above the observed one.

    Log masses are running sums of ln((n - i + 1) / i), so a test over many pairs neither overflows nor
    sits in one row.
    """
    n = F.col(higher) + F.col(lower)
    terms = df.where(n > 0).select(*keys, n.alias("_n"), F.col(higher).alias("_k"), F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("_i"))
    step = F.when(F.col("_i") > 0, F.ln((F.col("_n") - F.col("_i") + 1).cast("double") / F.col("_i").cast("double"))).otherwise(F.lit(0.0))
    logs = running(terms.withColumn("_step", step), keys, ["_i"], sums={"_log": F.col("_step")})
    masses = cut_lineage(logs.withColumn("_p", F.exp(F.col("_log") - F.col("_n") * F.ln(F.lit(2.0)))).select(*keys, "_i", "_k", "_p"))
    seen = masses.where(F.col("_i") == F.col("_k")).select(*keys, (F.col("_p") + F.lit(1e-12)).alias("_seen"))
    total = masses.join(seen, keys).where(F.col("_p") <= F.col("_seen")).groupBy(*keys).agg(F.sum("_p").alias("_sum"))
    return df.join(total, keys, "left").withColumn(
        "sign_test_p", F.when(F.col("_sum").isNotNull(), F.least(F.lit(1.0), F.col("_sum")))
    ).drop("_sum")


# --- resampling -------------------------------------------------------------------------------------

def resample_weights(items: DataFrame, keys: list[str], order_by: list, resamples: int, seed: Column) -> DataFrame:
    """How often each item is drawn in each resample: (keys, item columns, replicate, weight).

    The 32-bit generator is a counter, so draw ``replicate * n + j`` is computed where it is needed and the
    stream equals the sequential one. Draws spread over all tasks; each meets its item by position.
    """
    placed = ranked(items, keys, order_by, name="_at").withColumn("_at", F.col("_at") - 1)
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(seed).alias("_seed"))
    # Draws are exploded in stretches, so one replicate of a large group is many rows before it is many draws. The
    # number of partitions is explicit: by size alone the few rows before the explode would share one task.
    stretch = 4096
    parts = slice_count(items.sparkSession)
    draws = (
        sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(stretch).cast("bigint"))))
        .repartition(parts, *keys, "replicate", "_from")
        .withColumn("_j", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (stretch - 1), F.col("_n") - 1))))
    )
    place = F.col("replicate").cast("bigint") * F.col("_n") + F.col("_j")
    weights = (
        M.with_mulberry32(draws, F.col("_seed"), place, "_u").withColumn("_at", F.floor(F.col("_u") * F.col("_n")).cast("bigint"))
        .groupBy(*keys, "replicate", "_at")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return weights.join(placed, [*keys, "_at"]).drop("_at")


def _positions(seed: int, first: int, count: int, n: int) -> np.ndarray:
    """Items 0 to n - 1 that draws ``first`` and on of the 32-bit generator fall on, as ``with_mulberry32`` gives them."""
    step = (np.arange(first + 1, first + count + 1) & 0xFFFFFFFF).astype(np.uint32) * np.uint32(0x6D2B79F5)
    a = np.uint32(seed & 0xFFFFFFFF) + step
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return np.floor((t ^ (t >> np.uint32(14))) / 4294967296.0 * n).astype(np.int64)


def _drawn_cells(groups: DataFrame, keys: list[str], resamples: int, by_block: bool) -> DataFrame:
    """(keys, replicate, _cell, weight): draws by cell, counted in the task that makes them; no draw leaves it.

    ``groups`` has the keys, _n, _seed and _cells: the first positions of the cells in order, and the number of a cell
    is its place there; or, ``by_block``, the cell numbers of the items from position _base on, -1 for none.
    """
    names = [*keys, "replicate", "_cell", "weight"]
    schema = StructType([*[groups.schema[k] for k in keys], StructField("replicate", IntegerType()), StructField("_cell", IntegerType()), StructField("weight", LongType())])
    turns = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(REPLICATES_AT_ONCE)))
    base = F.col("_base") if by_block else F.lit(0).cast("bigint")
    rows = groups.select(*keys, "_n", F.col("_seed").cast("bigint").alias("_seed"), base.alias("_base"), "_cells", turns.alias("_turn"))
    rows = rows.repartition(slice_count(groups.sparkSession), *keys, "_base", "_turn")

    def count(cells, n, seed, base, replicate):
        held = np.zeros(len(cells) if not by_block else int(cells.max(initial=-1)) + 1, np.int64)
        for j in range(0, n, STRETCH):
            at = _positions(seed, replicate * n + j, min(STRETCH, n - j), n)
            if by_block:
                at = at[(at >= base) & (at < base + len(cells))] - base
                found = cells[at]
                held += np.bincount(found[found >= 0], minlength=len(held))
            else:
                held += np.bincount(np.searchsorted(cells, at, "right") - 1, minlength=len(held))
        return held

    def run(batches):
        for batch in batches:
            column = {c: batch.column(c) for c in ("_n", "_seed", "_base", "_turn")}
            for i in range(batch.num_rows):
                n, seed, base, turn = (column[c][i].as_py() for c in ("_n", "_seed", "_base", "_turn"))
                cells = batch.column("_cells")[i].values.to_numpy()
                for replicate in range(turn, min(turn + REPLICATES_AT_ONCE, resamples)):
                    held = count(cells, n, seed, base, replicate)
                    drawn = np.flatnonzero(held)
                    group = [pa.array([batch.column(k)[i].as_py()] * len(drawn), batch.column(k).type) for k in keys]
                    found = [pa.array(np.full(len(drawn), replicate, np.int32)), pa.array(drawn.astype(np.int32)), pa.array(held[drawn])]
                    yield pa.RecordBatch.from_arrays([*group, *found], names=names)

    return rows.mapInArrow(run, schema)


def _numbered(cells: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Cells with _cell, their number from 0 in the order of the cell columns, and _first, the items before them."""
    placed = running(cells, keys, cell, sums={"_cell": F.lit(1).cast("bigint"), "_upto": F.col("_items")})
    return cut_lineage(placed.select(*keys, *cell, (F.col("_cell") - 1).cast("int").alias("_cell"), (F.col("_upto") - F.col("_items")).alias("_first"), "_items"))


def resample_cells(items: DataFrame, keys: list[str], cell: list[str], resamples: int, seed: Column) -> DataFrame:
    """How often each cell of equal items is drawn in each resample: (keys, cell columns, replicate, weight).

    Items stand in the order of the cell columns, so a drawn position falls into a cell by the cells' first positions,
    found by bisection in an array of as many numbers as a group has cells. Cells are few (scores in hundredths and a
    label); items may be many.
    """
    placed = _numbered(items.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_items")), keys, cell)
    groups = placed.groupBy(*keys).agg(F.sum("_items").alias("_n"), F.sort_array(F.collect_list("_first")).alias("_cells")).withColumn("_seed", seed)
    return _drawn_cells(groups, keys, resamples, False).join(placed.select(*keys, *cell, "_cell"), [*keys, "_cell"]).drop("_cell")


def resample_cells_in_order(items: DataFrame, keys: list[str], cell: list[str], order_by: list, resamples: int, seed: Column) -> DataFrame:
    """The same of items in a given order, cells with a null left out.

    The cells of BLOCK_ITEMS items in order are one array. Each block counts what falls on it of all draws of its group: a
    draw is made again for every block, and neither a draw nor an item is shuffled by position.
    """
    known = items.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_items")).where(" and ".join(f"`{c}` is not null" for c in cell))
    placed = _numbered(known, keys, cell).select(*keys, *cell, "_cell")
    at = F.col("_at") - 1
    ordered = ranked(items.join(placed, [*keys, *cell], "left").select(*keys, *order_by, F.coalesce("_cell", F.lit(-1)).alias("_cell")), keys, order_by, name="_at")
    block = F.floor(at / BLOCK_ITEMS).cast("bigint") * BLOCK_ITEMS
    own = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_cell"))), lambda x: x["_cell"])
    blocks = cut_lineage(ordered.groupBy(*keys, block.alias("_base")).agg(own.alias("_cells"), F.count(F.lit(1)).alias("_held")))
    sizes = blocks.groupBy(*keys).agg(F.sum("_held").alias("_n")).withColumn("_seed", seed)
    drawn = _drawn_cells(blocks.drop("_held").join(sizes, keys), keys, resamples, True)
    counted = drawn.groupBy(*keys, "replicate", "_cell").agg(F.sum("weight").alias("weight"))
    return counted.join(placed, [*keys, "_cell"]).drop("_cell")


def _at_index(values: DataFrame, keys: list[str], value: str, low: Column, high: Column) -> DataFrame:
    """Values at two 0-based positions of each group's sorted list."""
    ordered = ranked(values.where(F.col(value).isNotNull()), keys, [value, "replicate"], name="_r")
    sizes = ordered.groupBy(*keys).agg(F.count(F.lit(1)).alias("draws"))
    marked = ordered.join(sizes, keys)
    return marked.groupBy(*keys, "draws").agg(
        F.max(F.when(F.col("_r") - 1 == low, F.col(value))).alias("lo"),
        F.max(F.when(F.col("_r") - 1 == high, F.col(value))).alias("hi"),
    )


def percentile_interval(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """95% interval, nulls dropped, at min(n - 1, floor(q n))."""
    n = F.col("draws")
    at = lambda q: F.least(n - 1, F.floor(n * F.lit(q)).cast("bigint"))
    return _at_index(values, keys, value, at(0.025), at(0.975))


def percentile_interval_strict(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """95% interval at floor(.025 (n-1)) and ceil(.975 (n-1)); null under 20 draws."""
    n = F.col("draws")
    out = _at_index(
        values, keys, value, F.floor((n - 1) * F.lit(0.025)).cast("bigint"), F.ceil((n - 1) * F.lit(0.975)).cast("bigint")
    )
    return out.select(*keys, "draws", *[F.when(n >= 20, F.col(c)).alias(c) for c in ("lo", "hi")])


def bootstrap_auc(df: DataFrame, keys: list[str], score: str, label: str, resamples: int, seed: Column) -> DataFrame:
    """AUC of every resample of rows in order of label and score: (keys, replicate, auc), null with one class."""
    weighted = resample_cells(df, keys, [label, score], resamples, seed)
    return auc(weighted, [*keys, "replicate"], score, label, weight=F.col("weight")).select(*keys, "replicate", "auc")


def bootstrap_auc_in_order(df: DataFrame, keys: list[str], score: str, label: str, order_by: list, resamples: int, seed: Column) -> DataFrame:
    """The same of rows in a given order, which gives groups of the same items the same draws."""
    weighted = resample_cells_in_order(df.select(*keys, score, label, *order_by), keys, [label, score], order_by, resamples, seed)
    return auc(weighted, [*keys, "replicate"], score, label, weight=F.col("weight")).select(*keys, "replicate", "auc")


def grid_counts(df: DataFrame, keys: list[str], score: str, grid: tuple, flags: dict[str, Column]) -> DataFrame:
    """Rows at or above every grid point (hundredths), from one pass over the rows.

    Each row lands on the highest grid point it reaches; counts above come from the few bins per group.
    """
    reached = F.array_max(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: F.col(score) >= g.cast("double") / F.lit(100.0) - F.lit(K.DELTA_EPSILON)))
    bins = df.withColumn("_bin", F.coalesce(reached, F.lit(-1))).groupBy(*keys, "_bin").agg(
        *[F.count_if(c).cast("bigint").alias(n) for n, c in flags.items()]
    )
    points = bins.withColumn("at", F.explode(F.array(*[F.lit(g) for g in grid])))
    return points.groupBy(*keys, "at").agg(
        *[F.sum(F.when(F.col("_bin") >= F.col("at"), F.col(n)).otherwise(0)).cast("bigint").alias(n) for n in flags]
    )
