"""Session helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; there is no other."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if not shared:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    context.setCheckpointDir(shared)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result once, so that every reader sees the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
