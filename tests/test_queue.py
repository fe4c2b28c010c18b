from pyspark.sql import functions as F

from pairloom.operators import report as R
from pairloom.plans import reports as P


def test_runs_come_from_counts(spark, folder):
    """the whole queue was ordered, and its cells made twice, to find where the runs begin."""
    cells = P.cells(spark, folder).select("signal_id", "position", "pack_id", "p_positive", "band")
    queue = R.queue(cells)
    want = queue.groupBy("part", "signal_id").agg(F.count(F.lit(1)).alias("items"), F.min("number").alias("first_number"), F.max("number").alias("last_number"))
    got = P.queue_groups(spark, folder)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "p_positive DESC" not in plan and "ExistingRDD" not in plan
