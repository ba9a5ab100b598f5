"""Size checks of broadcast sides, and the shared folder of written tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast hint for a side whose row bound is known to be small; else no hint."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def broadcast_if_counted(df: DataFrame) -> DataFrame:
    """Broadcast hint for a caller's table after a count that stops at the limit; else no hint."""
    return broadcast_if_small(df, df.limit(BROADCAST_ROWS + 1).count())


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; make one only where none is set."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tenura-checkpoint-"))
