"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import pickle
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


#: Temporary folders of sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in the session; a fresh temporary one only where none is set."""
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not named:
        named = _OWN.get(context.applicationId)
        if named is None:
            named = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="shared-")
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: lineage ends here, and a lost executor costs no more
    than the tasks it ran. The shuffle files of the write are given back when it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


class Shipped:
    """A broadcast value whose classes are shipped by value too, so that executors need no copy of this
    package. A task unpickles it once."""

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.found: list = []

    def __getstate__(self) -> dict:
        return {"data": self.data, "found": []}

    @property
    def value(self):
        if not self.found:
            self.found.append(pickle.loads(self.data.value))
        return self.found[0]


def kept_by_worker(name: str) -> dict:
    """A dictionary of the Python worker that outlives its tasks. Functions shipped by value have
    globals of their own in each task, so it lies in a module made on the spot."""
    return sys.modules.setdefault(f"_kept_{name}", types.ModuleType(f"_kept_{name}")).__dict__
