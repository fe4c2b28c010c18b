"""Bounded samples of labelled rows for fitting, chosen by hash so that every run sees the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import held_out

_SPAN = 1 << 40


def _position(id_col: str = "doc_id") -> Column:
    """A place in [0, 2^40) by hash of the id."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(_SPAN))


def balanced_sample(rows: DataFrame, by: str, per_value: int) -> DataFrame:
    """About ``per_value`` rows for each value of ``by`` (all, if fewer); one count per value reaches the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(by) == F.lit(value)) & (_position() < F.lit(int(_SPAN * min(1.0, per_value / n)))))
    return rows.where(keep)


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): all labels of the training fold, rows without id or label left out. A document labelled twice counts
    as its largest label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    return known.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_ids(labels: DataFrame, label: str, per_value: int) -> DataFrame:
    """(doc_id, y): a bounded sample of training_labels. At most about 2 * per_value rows, so it may be broadcast."""
    return balanced_sample(training_labels(labels, label), "y", per_value)


def with_sample(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sampled documents; the sample is bounded by its parameter and broadcast, texts are not shuffled."""
    return docs.join(F.broadcast(sample), "doc_id")
