"""Session defaults and reliable lineage cuts."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pairloom", master: str | None = None) -> SparkSession:
    """A session with the settings the operators assume; cluster values win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in defaults.items():
        builder = builder.config(key, value)
    if master and master.startswith("local"):
        cores = os.environ.get("BENCH_CPUS", "8")
        builder = builder.config("spark.sql.shuffle.partitions", cores).config(
            "spark.driver.memory", os.environ.get("PAIRLOOM_DRIVER_MEMORY", "12g")
        )
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; invent a folder only for local sessions."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one.

    A checkpoint keeps the constraints of the plan that made it, and these multiply where rounds of self-joins rename
    columns, until planning takes minutes. They are not derived for the plan that is cut.
    """
    ensure_checkpoint_dir(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(key, "true")
    conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder, for rounds of joins.

    A checkpoint keeps the size its plan was estimated at, which for a join is the product of both sides': over rounds
    that number grows until planning takes minutes. Of a written table Spark knows the true size.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = posixpath.join(df.sparkSession.sparkContext.getCheckpointDir(), f"rows-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slice_count(spark: SparkSession) -> int:
    """Partitions for explicit repartitioning: the shuffle setting, in local mode no more than the cores."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    context = spark.sparkContext
    return min(parts, context.defaultParallelism) if context.master.startswith("local") else parts
