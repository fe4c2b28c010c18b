"""Texts reworded in growing steps, each judged in the task that holds it: no step's words or shingles are ever written."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from pairloom import constants as K
from pairloom.operators.similarity import _window_hashes

# Functions that run in tasks are pickled by value, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RENAMED = "id"


def _digest(word: str) -> bytes:
    return hashlib.md5(word.encode()).digest()


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(len(x) + len(y) - common, 1)


def reworded(rows: DataFrame, steps: tuple[float, ...], k: int = K.SHINGLE_WIDTH) -> DataFrame:
    """(id, step, jaccard): the first step that leaves a text no more than its ``stop`` of its shingles, else nulls.

    ``rows`` has id, stop and tokens. A step renames the words whose hash falls under its share. Shingles are compared as
    64-bit hashes: a polynomial over hashes of the words.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            words = lists.flatten().dictionary_encode()
            digests = [_digest(w) for w in [*words.dictionary.to_pylist(), RENAMED]]
            codes = words.indices.to_numpy(zero_copy_only=False)
            share = np.array([int.from_bytes(d[:2], "big") for d in digests]) / 65536.0
            hashes = np.array([int.from_bytes(d[8:], "big") for d in digests], np.uint64)
            found = []
            for a, b, stop in zip(ends[:-1], ends[1:], batch.column("stop").to_pylist()):
                own = codes[a:b]
                before, first = np.unique(_window_hashes(hashes[own], k)), (None, None)
                for step in steps:
                    after = _window_hashes(np.where(share[own] < step, hashes[-1], hashes[own]), k)
                    j = _jaccard(before, np.unique(after))
                    if j <= stop:
                        first = (step, j)
                        break
                found.append(first)
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "step", "jaccard"])

    return rows.mapInArrow(run, "id long, step double, jaccard double")
