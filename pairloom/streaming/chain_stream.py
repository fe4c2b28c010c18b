"""The hash-chain check as a stream: the batch check's problems, whatever order the events arrive in.

An event is compared with the one before it, so state is keyed by blocks of sequence numbers: a block holds its own events
and the last one of the block before, and the whole log never shares one key. Waiting events and hashes whose successor
has not come are the state; both go as soon as they have met. An event whose predecessor does not come within the given
time is a gap. State lives in the store named by the checkpoint, so a restart goes on where the stream stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pairloom.operators.journal import event_hash

BLOCK = 10_000
PROBLEMS = "seq bigint, problem string"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ChainCheck(StatefulProcessor):
    """State of a block: ``hashes`` by sequence number of events whose successor is awaited, and ``waiting`` events with
    the hash they name and the time until which their predecessor is awaited."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hashes = handle.getMapState("hashes", "seq bigint", "hash string")
        self.waiting = handle.getMapState("waiting", "seq bigint", "previous string, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = []
        now = timerValues.getCurrentProcessingTimeInMs()
        for table in rows:
            for seq, own, event, previous, broken in zip(table["seq"], table["own"], table["event_hash"], table["previous_hash"], table["broken"]):
                seq = int(seq)
                previous = None if pd.isna(previous) else previous
                if own and broken:
                    found.append((seq, "event_hash"))
                elif own and seq == 0:
                    if previous is not None:
                        found.append((seq, "previous_hash"))
                elif own and self.hashes.containsKey((seq - 1,)):
                    if self.hashes.getValue((seq - 1,))[0] != previous:
                        found.append((seq, "previous_hash"))
                    self.hashes.removeKey((seq - 1,))
                elif own:
                    self.waiting.updateValue((seq,), (previous, now + self.patience_ms))
                    self.handle.registerTimer(now + self.patience_ms)
                if self.waiting.containsKey((seq + 1,)):
                    if self.waiting.getValue((seq + 1,))[0] != event:
                        found.append((seq + 1, "previous_hash"))
                    self.waiting.removeKey((seq + 1,))
                else:
                    self.hashes.updateValue((seq,), (event,))
        yield pd.DataFrame(found, columns=["seq", "problem"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        time = expiredTimerInfo.getExpiryTimeInMs()
        late = [seq[0] for seq, value in self.waiting.iterator() if value[1] <= time]
        for seq in late:
            self.waiting.removeKey((seq,))
        yield pd.DataFrame([(seq, "sequence_gap") for seq in late], columns=["seq", "problem"])

    def close(self) -> None:
        pass


def chain_problems(events: DataFrame, body: list[str], patience_ms: int = 600_000, block: int = BLOCK) -> DataFrame:
    """(seq, problem) of a streaming log with seq, event_hash, previous_hash and the columns of ``body``.

    Sequence numbers are distinct; the session's state store must be STORE.
    """
    rows = events.select("seq", "event_hash", "previous_hash", (F.col("event_hash") != event_hash(*body)).alias("broken"))
    # The last event of a block is known to the next block too, as a predecessor only.
    homes = F.when((F.col("seq") + 1) % block == 0, F.array(F.struct(F.lit(True).alias("own"), F.lit(0).alias("ahead")), F.struct(F.lit(False).alias("own"), F.lit(1).alias("ahead")))).otherwise(
        F.array(F.struct(F.lit(True).alias("own"), F.lit(0).alias("ahead")))
    )
    dealt = rows.withColumn("home", F.explode(homes)).select((F.floor(F.col("seq") / block) + F.col("home.ahead")).cast("bigint").alias("block"), "seq", "event_hash", "previous_hash", "broken", F.col("home.own").alias("own"))
    return dealt.groupBy("block").transformWithStateInPandas(ChainCheck(patience_ms), outputStructType=PROBLEMS, outputMode="append", timeMode="ProcessingTime")


def start(problems: DataFrame, out: str, checkpoint: str, every: str = "1 second"):
    """The running query. It goes on until it is stopped: while events wait, there is always a time left to come."""
    writer = problems.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(processingTime=every).start()


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(*STORE)
