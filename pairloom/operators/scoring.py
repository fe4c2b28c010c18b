"""Pluggable scorers. The outside model is not called here; the offline ones are known-answer stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text as T


def offline(kind: str, **columns: str) -> Column:
    """Score as a column expression: hash, oracle, inverse or constant."""
    if kind == "hash":
        return T.two_decimals(T.unit_hash(F.lit(columns.get("seed", "p")), F.col(columns["id"])))
    if kind in ("oracle", "inverse"):
        hit = F.col(columns["label"]) == 1
        return F.when(hit if kind == "oracle" else ~hit, F.lit(0.9)).otherwise(F.lit(0.1))
    if kind == "constant":
        return F.lit(0.5)
    raise ValueError(f"unknown scorer {kind}")


def score_with(df: DataFrame, scorer: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Run a scorer over Arrow batches of each partition: one batch in, its scored rows out."""
    return df.mapInPandas(scorer, schema=schema)
