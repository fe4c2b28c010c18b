"""Periodic runs of words: maximal stretches that repeat with some smallest period q at least REPEATS times.

A run of period q in [b, 2b), b a power of two, matches itself shifted by q over at least 2q words, so one of the
blocks of b words that begin at multiples of b lies in the match. At every such dyadic scale b all blocks are compared
with the words that follow them, by the sum of squared differences of word numbers: its cross term is a cyclic
convolution of 2b points, computed by an integer number-theoretic transform modulo PRIME. A zero marks an occurrence of
the block at that distance. The transform of a block serves three times, for itself and for the windows of the two
blocks before it, so a scale costs two transforms a block. A sum that is a multiple of PRIME without being zero is no
occurrence; like every seed it is extended by comparing words, so nothing false is reported and nothing is lost.

Occurrences of neighbouring blocks at one distance form a chain; a chain is extended by less than a block to both sides,
by bisection over polynomial hashes modulo PRIME in two bases. A stretch found with a multiple of its smallest period
equals the stretch of that smallest period, so of equal stretches the smallest distance stays.

Texts of a batch are laid end to end, about a megabyte at a time; a longer text is taken whole, and memory follows its
number of words. Cost grows as n log^2 n with the words of a text, whatever they are.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; a null id is carried along;
repeated rows are each answered; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import words as W
from pairloom.llm.tables import id_and_text, read

LEAST = 24
REPEATS = 3
FIRST_BLOCK = 8

# A prime of the form k * 2^27 + 1 with the generator 31: transforms of up to 2^27 points, products below 2^62.
PRIME, GENERATOR = 2013265921, 31
_P = np.uint64(PRIME)
_POINTS = 1 << 17
_BASES = (1480231213, 906180109)
_RUN_SQL = "array<struct<start:long,length:long,period:long>>"


def _mod(x: np.ndarray) -> np.ndarray:
    return x - (x // _P) * _P


def _plus(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    t = u + v
    return np.minimum(t, t - _P)


def _minus(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    t = u - v
    return np.minimum(t, t + _P)


def powers_mod(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo PRIME, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = _mod(out[:step] * np.uint64(pow(base, have, PRIME)))
        have += step
    return out


@lru_cache(maxsize=64)
def _roots(points: int, inverse: bool) -> np.ndarray:
    """The first half of the roots of unity of order points, as a column."""
    root = pow(GENERATOR, (PRIME - 1) // points, PRIME)
    return powers_mod(pow(root, -1, PRIME) if inverse else root, points // 2)[:, None]


@lru_cache(maxsize=32)
def _negated(points: int) -> np.ndarray:
    """Where frequency -k stands, for every place of an array in bit-reversed order of k."""
    at = np.zeros(1, np.int64)
    while len(at) < points:
        at = np.concatenate([2 * at, 2 * at + 1])
    place = np.empty(points, np.int64)
    place[at] = np.arange(points)
    return place[(-at) % points]


def forward(blocks: np.ndarray) -> np.ndarray:
    """Transforms of columns of b numbers followed by b zeros: 2b frequencies in bit-reversed order."""
    points, columns = 2 * blocks.shape[0], blocks.shape[1]
    values = np.concatenate([blocks, _mod(blocks * _roots(points, False))])
    half = points // 4
    while half:
        v = values.reshape(-1, 2, half, columns)
        out = np.empty_like(v)
        out[:, 0] = _plus(v[:, 0], v[:, 1])
        out[:, 1] = _mod(_minus(v[:, 0], v[:, 1]) * _roots(2 * half, False))
        values, half = out.reshape(points, columns), half // 2
    return values


def inverse_first_half(values: np.ndarray) -> np.ndarray:
    """The first half of the numbers whose frequencies, in bit-reversed order, are the columns of values."""
    points, columns = values.shape
    half = 1
    while 2 * half < points:
        v = values.reshape(-1, 2, half, columns)
        turned = _mod(v[:, 1] * _roots(2 * half, True))
        out = np.empty_like(v)
        out[:, 0] = _plus(v[:, 0], turned)
        out[:, 1] = _minus(v[:, 0], turned)
        values, half = out.reshape(points, columns), 2 * half
    v = values.reshape(2, half, columns)
    first = _plus(v[0], _mod(v[1] * _roots(points, True)))
    return _mod(first * np.uint64(pow(points, -1, PRIME)))


def block_occurrences(numbers: np.ndarray, b: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance): where block j of b numbers occurs again at a distance in [shift * b, (shift + 1) * b).

    A zero is a sum of squared differences that PRIME divides. Distance 0 is left out.
    """
    n_blocks = len(numbers) // b
    step = max(1, _POINTS // (2 * b))
    padded = np.zeros((n_blocks + step + 2) * b + b, np.uint64)
    padded[: len(numbers)] = numbers
    found = []
    for first in range(0, n_blocks, step):
        count = min(step, n_blocks - first)
        part = padded[first * b : (first + count + shift + 1) * b]
        columns = np.ascontiguousarray(part.reshape(-1, b).T)
        waves = forward(columns)
        window = waves[:, shift : shift + count + 1]
        # A window is two blocks; the second is shifted by half the points, which turns the sign of odd frequencies.
        both = np.empty((2 * b, count), np.uint64)
        both[:b] = _plus(window[:b, :-1], window[:b, 1:])
        both[b:] = _minus(window[b:, :-1], window[b:, 1:])
        cross = inverse_first_half(_mod(waves[_negated(2 * b)][:, :count] * both))
        squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mod(part * part))])
        begin = np.arange(count) * b
        own = squares[begin + b] - squares[begin]
        at = begin[None, :] + (np.arange(b) + shift * b)[:, None]
        there = squares[at + b] - squares[at]
        distance, block = np.nonzero(_mod(own[None, :] + there) == _mod(cross + cross))
        found.append((block + first, distance + shift * b))
    blocks, distances = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return blocks[distances > 0], distances[distances > 0]


class _Hashes:
    """Equality of stretches of one sequence by polynomial hashes modulo PRIME in two bases."""

    def __init__(self, numbers: np.ndarray):
        values = _mod(W.mix(numbers.astype(np.uint64) + np.uint64(1)) >> np.uint64(2))
        self.parts = []
        for base in _BASES:
            power = powers_mod(base, len(values) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mod(values * power[:-1]), dtype=np.uint64)])
            self.parts.append((_mod(total), power))

    def same(self, at: np.ndarray, distance: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether [at, at + length) equals the stretch at that distance after it."""
        equal = np.ones(len(at), bool)
        for total, power in self.parts:
            here = _minus(total[at + length], total[at])
            there = _minus(total[at + distance + length], total[at + distance])
            equal &= _mod(here * power[distance]) == there
        return equal


def _longest(fits, limit: np.ndarray) -> np.ndarray:
    """The largest length up to limit that fits, for a property that holds for all shorter ones, by bisection."""
    low, high = np.zeros(len(limit), np.int64), limit.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = fits(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def _extended(b, blocks, distances, bounds, hashes, least, repeats):
    """(start, end, distance) of the stretches that chains of occurrences of blocks of b words belong to."""
    begin = blocks * b
    document = np.searchsorted(bounds, begin, "right") - 1
    inside = begin + distances + b <= bounds[document + 1]
    begin, distances, document = begin[inside], distances[inside], document[inside]
    order = np.lexsort((begin, distances))
    begin, distances, document = begin[order], distances[order], document[order]
    if not len(begin):
        return begin, begin, begin
    new = np.concatenate([[True], (distances[1:] != distances[:-1]) | (begin[1:] != begin[:-1] + b) | (document[1:] != document[:-1])])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(begin)) - 1
    start, stop, distance, document = begin[head], begin[last] + b, distances[head], document[head]
    # A match of a whole run is at least so long, and holds at least so many blocks.
    match = np.maximum(least, repeats * distance) - distance
    enough = last - head + 1 >= (match - b + 1) // b
    start, stop, distance, document = start[enough], stop[enough], distance[enough], document[enough]
    low, high = bounds[document], bounds[document + 1]
    left = _longest(lambda n: hashes.same(start - n, distance, n), np.minimum(b - 1, start - low))
    right = _longest(lambda n: hashes.same(stop, distance, n), np.minimum(b - 1, high - stop - distance))
    start, end = start - left, stop + right + distance
    whole = end - start >= np.maximum(least, repeats * distance)
    return start[whole], end[whole], distance[whole]


def runs_of(numbers: np.ndarray, bounds: np.ndarray, least: int = LEAST, repeats: int = REPEATS):
    """(start, end, period) of every run in texts laid end to end, in order of start and period.

    numbers are small word numbers; text t is numbers[bounds[t]:bounds[t + 1]]; places count over all texts. Needs
    repeats >= 3 and least >= 3 * FIRST_BLOCK, so that a block of every scale fits into a run's match.
    """
    sizes = np.diff(bounds)
    found = []
    b = FIRST_BLOCK
    while True:
        texts = np.flatnonzero(sizes >= max(least, repeats * b if b > FIRST_BLOCK else 0))
        if not len(texts):
            break
        own = sizes[texts]
        at = np.concatenate([[0], np.cumsum(own)])
        place = np.arange(at[-1]) - np.repeat(at[:-1] - bounds[texts], own)
        part = numbers[place]
        hits = [block_occurrences(part, b, shift) for shift in ((0, 1) if b == FIRST_BLOCK else (1,))]
        blocks, distances = (np.concatenate(x) for x in zip(*hits))
        if len(blocks):
            start, end, distance = _extended(b, blocks, distances, at, _Hashes(part), least, repeats)
            found.append((place[start], place[end - 1] + 1, distance))
        b *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    step = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def join_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bytes of words, each followed by one space unless it is the last of its text."""
    length = ends - starts + ~last
    to = np.cumsum(length)
    out = raw[np.minimum(np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - length), length), max(len(raw) - 1, 0))]
    out[to[~last] - 1] = 32
    return out


def _answers(batches, least: int, repeats: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        raw, offsets = W.text_buffer(batch.column(1))
        for group in W.iter_words(batch.column(1), W.VISIBLE, W.SAME):
            bounds, rows = group.bounds.astype(np.int64), group.rows
            _, numbers = np.unique(group.hashes, return_inverse=True)
            start, end, period = runs_of(numbers.astype(np.uint64), bounds, least, repeats)
            kept = ~_covered(len(numbers), start + period, end)
            text = np.searchsorted(bounds, start, "right") - 1
            run_offsets = np.searchsorted(text, np.arange(rows + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(start - bounds[text]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
            # Kept words of each text, joined by one space.
            before = np.concatenate([[0], np.cumsum(kept)])
            have = before[bounds]
            last = np.zeros(have[-1], bool)
            last[have[1:][np.diff(have) > 0] - 1] = True
            base = int(offsets[group.first])
            joined = join_words(raw, group.starts[kept] + base, group.ends[kept] + base, last)
            sizes = np.concatenate([[0], np.cumsum(group.ends[kept] - group.starts[kept] + ~last)])
            collapsed = pa.StringArray.from_buffers(rows, pa.py_buffer(sizes[have].astype(np.int32)), pa.py_buffer(joined))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(group.first, rows), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(run_offsets), runs), collapsed],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(documents: DataFrame, least: int = LEAST, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of every row.

    A run has smallest period ``period``, at least max(least, repeats * period) words, and can't be extended; runs come
    in order of start and period, places are word numbers from 0. ``collapsed`` are the words that no run contains
    after its first ``period`` words, joined by one space. Nothing is shuffled: a text is answered where it is read.
    """
    if repeats < 3 or least < 3 * FIRST_BLOCK:
        raise ValueError(f"repeats must be 3 or more and least {3 * FIRST_BLOCK} or more")
    rows = id_and_text(documents, id_col, text_col)
    return rows.mapInArrow(lambda batches: _answers(batches, least, repeats), f"doc_id long, n_words long, runs {_RUN_SQL}, collapsed string")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32 of the id is a multiple of 10, words from a place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    planted = id_and_text(documents).withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)))
    planted = planted.withColumn("_w", F.when(F.col("_g").isNotNull(), words))
    planted = planted.withColumn("_n", F.size("_w")).withColumn("_a", F.expr("IF(_n > 0, CAST(_g % _n AS INT), NULL)"))
    planted = planted.withColumn("_p", F.expr("CAST(1 + floor((_n - _a) / (3 + _g % 8)) AS INT)"))
    again = F.expr("array_join(concat(slice(_w, 1, _a), slice(flatten(array_repeat(slice(_w, _a + 1, _p), CAST(ceil((_n - _a) / _p) AS INT))), 1, _n - _a)), ' ')")
    return planted.select("doc_id", F.when(F.col("_a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def longest_exponent(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first. Null without runs."""
    better = lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, 0), better))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(read(spark, folder, "documents")))
    found = found.withColumn("best", longest_exponent(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[name].alias(name) for name in ("start", "length", "period")),
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# Runs of every period can't be listed by SQL in reasonable time; tests compare with brute force.
QUERIES = {"op13_periodic_runs": (op13, None)}
