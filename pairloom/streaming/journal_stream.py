"""The lifecycle check as a stream: the same codes as the batch query, found as events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "seq bigint, unit_id bigint, type string, status string"
PROBLEMS = "seq bigint, unit_id bigint, type string, problem string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """New JSONL files of a folder as they appear."""
    return spark.readStream.schema(EVENTS).json(folder)


def _check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Two flags per unit are all the state; events of a unit arrive in seq order across micro-batches."""
    reserved, finished = state.get if state.exists else (False, False)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, kind in zip(rows["seq"], rows["type"]):
        problem = None
        if kind == "reserved":
            problem = "duplicate_reservation" if reserved else None
            reserved = True
        elif kind == "finished":
            problem = "finish_without_reservation" if not reserved else "duplicate_finish" if finished else None
            finished = True
        if problem:
            out.append((seq, key[0], kind, problem))
    state.update((reserved, finished))
    yield pd.DataFrame(out, columns=["seq", "unit_id", "type", "problem"])


def lifecycle_problems(events: DataFrame) -> DataFrame:
    """Problem rows of a streaming log, keyed state per unit."""
    relevant = events.where("type IN ('reserved', 'finished')").select("seq", "unit_id", "type")
    return relevant.groupBy("unit_id").applyInPandasWithState(
        _check, PROBLEMS, "reserved boolean, finished boolean", "append", GroupStateTimeout.NoTimeout
    )


def run_available(problems: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop; the checkpoint makes a restart continue after the last batch."""
    problems.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True
    ).start().awaitTermination()
