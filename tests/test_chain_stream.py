"""The streaming chain check: the batch check's problems under any order of files, with restarts and a gap."""

import json
import random
import time

import pytest

from pairloom.operators import journal as J
from pairloom.streaming import chain_stream

SCHEMA = "seq bigint, type string, event_hash string, previous_hash string"


def log(spark, n):
    rows = spark.range(n).selectExpr("id AS seq", "concat('t', id % 3) AS type").withColumn("event_hash", J.event_hash("seq", "type")).collect()
    out = [{"seq": r.seq, "type": r.type, "event_hash": r.event_hash, "previous_hash": rows[i - 1].event_hash if i else None} for i, r in enumerate(rows)]
    out[7]["event_hash"] = "x"
    out[20]["previous_hash"] = "y"
    out[30]["type"] = "changed"
    del out[45]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch_check_in_any_order(spark, tmp_path, seed):
    rows = log(spark, 60)
    want = {(r.seq, r.problem) for r in J.chain_violations(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), ["seq", "type"]).collect()}
    assert {p for _, p in want} == {"event_hash", "previous_hash", "sequence_gap"}
    random.Random(seed).shuffle(rows)
    # The event whose predecessor is missing comes in the second run, whose patience is short.
    rows.sort(key=lambda r: r["seq"] == 46)
    source, out, checkpoint = (tmp_path / name for name in ("in", "out", "cp"))
    source.mkdir()
    before = spark.conf.get(chain_stream.STORE[0])
    chain_stream.use_state_store(spark)
    try:
        # Two runs over one checkpoint; the second waits until the event that never comes is overdue.
        for run, part in enumerate((rows[:25], rows[25:])):
            (source / f"{run}.json").write_text("\n".join(json.dumps(r) for r in part))
            stream = spark.readStream.schema(SCHEMA).json(str(source))
            query = chain_stream.start(chain_stream.chain_problems(stream, ["seq", "type"], patience_ms=600_000 if run == 0 else 2_000, block=16), str(out), str(checkpoint))
            try:
                deadline = time.time() + 60
                while time.time() < deadline and not query.exception():
                    time.sleep(1)
                    done = query.lastProgress is not None and sum(p["numInputRows"] for p in query.recentProgress) >= len(part)
                    if done and (run == 0 or (out.exists() and spark.read.schema(chain_stream.PROBLEMS).parquet(str(out)).where("problem = 'sequence_gap'").count())):
                        break
                assert query.exception() is None
            finally:
                query.stop()
        got = {(r.seq, r.problem) for r in spark.read.schema(chain_stream.PROBLEMS).parquet(str(out)).collect()}
    finally:
        spark.conf.set(chain_stream.STORE[0], before)
    assert got == want
