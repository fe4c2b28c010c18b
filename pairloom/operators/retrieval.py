"""Does retrieval find what is there: planted rewritten copies, their ranks, and every pair of bounded slices.

Units are dealt into slices of about ``slice_units`` by a hash of their id, so the slices cover all units and the
number of pairs tested grows with the units, not with their square. Inside its slice every pair is decided. Pairs are
never listed: they go straight into a histogram of scores, at most 10,000 rows a slice and kind of pair, and the rank of
a planted pair is one more than the number of better proposals in it.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import measures as M
from pairloom.functions import text as T
from pairloom.operators.similarity import SLACK, with_length_shape
from pairloom.session import cut_lineage

# Functions that run in tasks are pickled by value, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_UNITS = 440
SCORE_STEPS = 10_000
# Values of one matrix, and cells of histograms compared at a time.
STEP_VALUES, STEP_CELLS = 4096, 4_000_000
HISTOGRAM = "slice long, step long, rare boolean, natural boolean, planted boolean, n long"


def dealt(units: DataFrame, slice_units: int = SLICE_UNITS) -> DataFrame:
    """Add ``slice``: the unit's place in one of as many slices as hold about slice_units each."""
    slices = max(1, -(-units.count() // slice_units))
    return units.withColumn("slice", F.floor(T.unit_hash(F.lit("slice"), F.col("id")) * slices).cast("bigint"))


def rewritten(tokens: Column) -> Column:
    """Rename a fixed part of the words, each the same way wherever it stands; lengths and order stay."""
    return F.transform(tokens, lambda t: F.when((F.ascii(t) + F.length(t)) % 4 == 0, F.reverse(t)).otherwise(t))


def with_planted_copies(units: DataFrame, share: float, shift: int) -> DataFrame:
    """Units and, for a share of them drawn by hash, a rewritten copy in the same slice with the id moved by ``shift``."""
    natural = units.withColumn("original", F.lit(None).cast("bigint"))
    drawn = units.where(T.unit_hash(F.lit("plant"), F.col("id")) < share)
    planted = drawn.withColumn("original", F.col("id")).withColumn("id", F.col("id") + shift).withColumn("tokens", rewritten(F.col("tokens")))
    return natural.unionByName(planted.select(*natural.columns))


def profiled(units: DataFrame, surface_length: int, max_df: int = K.MAX_DOCUMENT_FREQUENCY) -> DataFrame:
    """(slice, id, original, lines, items, surface, frequent, shape): hashes of shingles and names, and the names too
    frequent in the slice to propose by."""
    written = cut_lineage(units)
    words = F.array_distinct(F.filter("tokens", lambda t: F.length(t) >= surface_length))
    shaped = with_length_shape(written, "id").withColumn("surface", F.transform(words, lambda w: F.xxhash64(w))).withColumn("items", T.shingle_hashes(F.col("tokens")))
    shaped = cut_lineage(shaped.drop("tokens"))
    often = shaped.select("slice", F.explode("surface").alias("name")).groupBy("slice", "name").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > max_df)
    frequent = often.groupBy("slice").agg(F.collect_list("name").alias("frequent"))
    return shaped.join(frequent, "slice", "left").withColumn("frequent", F.coalesce("frequent", F.array().cast("array<bigint>")))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    values = column.flatten().to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values every two sets share, by products of 0/1 matrices of so many values at a time."""
    count = len(sets)
    rows = np.repeat(np.arange(count), [len(s) for s in sets])
    _, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[codes]
    total = np.zeros((count, count), np.float32)
    for low in range(0, int(place.max(initial=-1)) + 1, STEP_VALUES):
        own = (place >= low) & (place < low + STEP_VALUES)
        held = np.zeros((count, STEP_VALUES), np.float32)
        held[rows[own], place[own] - low] = 1
        total += held @ held.T
    return total.astype(np.int64)


def _least_shape(lengths: list[np.ndarray], counts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the minima of both histograms, for each pair of rows."""
    known, codes = np.unique(np.concatenate(lengths), return_inverse=True)
    table = np.zeros((len(lengths), len(known)), np.int64)
    table[np.repeat(np.arange(len(lengths)), [len(v) for v in lengths]), codes] = np.concatenate(counts)
    out, step = np.zeros(len(x), np.int64), max(1, STEP_CELLS // max(len(known), 1))
    for at in range(0, len(x), step):
        out[at : at + step] = np.minimum(table[x[at : at + step]], table[y[at : at + step]]).sum(1)
    return out


def _decide_slice(table: pa.Table, min_ratio: float, min_jaccard: float, min_score: float) -> dict:
    """Columns of HISTOGRAM of one slice."""
    table = table.sort_by("id")
    ids, lines, mass, original = (table.column(c).to_numpy() for c in ("id", "lines", "mass", "of"))
    surface, items = _lists(table.column("surface")), [np.sort(v) for v in _lists(table.column("items"))]
    size = np.array([len(s) for s in surface])
    ratio = lambda v, x, y: np.minimum(v[x], v[y]) / np.maximum(v[x], v[y])
    x, y = np.triu_indices(len(ids), 1)
    x, y = (v[ratio(lines, x, y) >= min_ratio] for v in (x, y))
    x, y = (v[ratio(size, x, y) + ratio(mass, x, y) >= 2 * min_score - SLACK] for v in (x, y))
    common = _common(surface)
    frequent = table.column("frequent")[0].values.to_numpy(zero_copy_only=False)
    often = _common([s[np.isin(s, frequent)] for s in surface])
    overlap = lambda: common[x, y] / np.maximum(size[x] + size[y] - common[x, y], 1)
    x, y = (v[overlap() + ratio(mass, x, y) >= 2 * min_score - SLACK] for v in (x, y))
    least = _least_shape(_lists(table.column("lengths")), _lists(table.column("counts")), x, y)
    score = (overlap() + least / (mass[x] + mass[y] - least)) / 2.0
    good = score >= min_score
    x, y, score = x[good], y[good], score[good]
    shared = np.array([len(np.intersect1d(items[a], items[b], assume_unique=True)) for a, b in zip(x, y)], np.int64)
    of_items = np.array([len(v) for v in items], np.int64)
    good = shared / np.maximum(of_items[x] + of_items[y] - shared, 1) < min_jaccard
    x, y, score = x[good], y[good], score[good]
    step = np.floor(score * SCORE_STEPS + 0.5).astype(np.int64)
    flags = [common[x, y] > often[x, y], (original[x] < 0) & (original[y] < 0), original[y] == ids[x]]
    kinds, n = np.unique(np.stack([step, *flags], 1), axis=0, return_counts=True)
    return {"step": kinds[:, 0], **{name: kinds[:, i].astype(bool) for i, name in enumerate(("rare", "natural", "planted"), 1)}, "n": n}


def decided_pairs(profiles: DataFrame, min_lines=K.MIN_LINES, min_ratio=K.MIN_SIZE_RATIO, min_jaccard=K.MIN_JACCARD, min_score=K.MIN_SCORE, min_surface=K.MIN_SURFACE) -> DataFrame:
    """How many pairs of a slice pass, as (slice, step, rare, natural, planted, n).

    A slice holds about SLICE_UNITS units, whatever the corpus, and its pairs are counted in one task. Cheap bounds come
    first: line ratio, then the score that sizes alone allow, then the surfaces, the shapes and the shingles. step is the
    score in steps of 1 / SCORE_STEPS, rare says whether the index would meet the pair.
    """
    mass = F.aggregate(F.map_values("shape"), F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    able = profiles.where((F.col("lines") >= min_lines) & (F.size("surface") >= min_surface)).select(
        "slice", "id", F.coalesce("original", F.lit(-1).cast("bigint")).alias("of"), "lines", mass.alias("mass"), "surface", "items", "frequent",
        F.map_keys("shape").alias("lengths"), F.map_values("shape").alias("counts"),
    )

    def decide(table: pa.Table) -> pa.Table:
        found = _decide_slice(table, min_ratio, min_jaccard, min_score)
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()] * len(found["n"]), pa.int64()), **found})

    return able.groupBy("slice").applyInArrow(decide, HISTOGRAM)


def validated(profiles: DataFrame, cap: int = K.LOW_OVERLAP_CAP, min_lines: int = K.MIN_LINES, **limits) -> DataFrame:
    """One row a slice: planted copies, those found within the cap, ranks, and how many natural pairs pass at all."""
    histogram = cut_lineage(decided_pairs(profiles, min_lines=min_lines, **limits))
    # A slice has at most SCORE_STEPS scores, so its window is bounded.
    steps = histogram.where("rare").groupBy("slice", "step").agg(F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("slice").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = histogram.where("planted and rare").join(steps.select("slice", "step", (above + 1).alias("rank")), ["slice", "step"])
    within = F.col("rank") <= cap
    ranks = placed.groupBy("slice").agg(
        F.sum("n").alias("retrieved"), F.coalesce(F.sum(F.when(within, F.col("n"))), F.lit(0)).alias("found"),
        F.min("rank").alias("best_rank"), F.max(F.when(within, F.col("rank"))).alias("worst_rank"), F.max("rank").alias("worst_rank_uncapped"),
    )
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    passing = histogram.groupBy("slice").agg(
        total(F.expr("rare")).alias("proposed"), total(F.expr("natural")).alias("passing"), total(F.expr("natural and rare")).alias("found_by_index")
    )
    natural = F.col("original").isNull() & (F.col("lines") >= min_lines)
    pools = profiles.groupBy("slice").agg(F.count_if(natural).alias("pool"), F.count_if(F.col("original").isNotNull()).alias("planted"))
    pairs = F.floor(F.col("pool") * (F.col("pool") - 1) / 2).cast("bigint")
    zero = ["proposed", "passing", "found_by_index", "retrieved", "found"]
    return (
        pools.join(passing, "slice", "left").join(ranks, "slice", "left").fillna(0, zero)
        .withColumn("pairs", pairs).withColumn("pass_rate", M.rate(F.col("passing"), F.col("pairs")))
        .withColumn("precision_lower_bound", M.rate(F.col("found"), F.least("proposed", F.lit(cap))))
    )


def planted_decisions(profiles: DataFrame, min_lines=K.MIN_LINES, min_ratio=K.MIN_SIZE_RATIO, min_jaccard=K.MIN_JACCARD, min_score=K.MIN_SCORE, min_surface=K.MIN_SURFACE) -> DataFrame:
    """(id, original, reason, score) of each planted copy against its original: which test decides the pair alone."""
    side = lambda s: profiles.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("original", "lines", "items", "surface", "shape")])
    met = side("b").where("original_b is not null").join(side("a"), F.col("original_b") == F.col("id_a"))
    score = (M.jaccard(F.col("surface_a"), F.col("surface_b")) + M.shape_similarity(F.col("shape_a"), F.col("shape_b"))) / F.lit(2.0)
    reason = (
        F.when(F.least("lines_a", "lines_b") < min_lines, "short")
        .when(F.least(F.size("surface_a"), F.size("surface_b")) < min_surface, "small_surface")
        .when(M.size_ratio(F.col("lines_a"), F.col("lines_b")) < min_ratio, "size_ratio")
        .when(M.jaccard(F.col("items_a"), F.col("items_b")) >= min_jaccard, "high_overlap")
        .when(score >= min_score, "proposed").otherwise("score")
    )
    return met.select(F.col("id_b").alias("id"), F.col("id_a").alias("original"), reason.alias("reason"), score.alias("score"))
