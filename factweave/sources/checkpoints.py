"""Cutting lineage through the shared checkpoint folder the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 500_000  # rows that may be broadcast


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a one-machine session may go without: it gets a fresh temporary one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="factweave-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def look_up(df: DataFrame) -> DataFrame:
    """df kept in the checkpoint folder, to be broadcast to what it is joined with if it has at most FEW rows. Spark's own
    estimate of a table behind an aggregate or a window follows its inputs, and would have a large other side shuffled."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.limit(FEW + 1).count() <= FEW else kept
