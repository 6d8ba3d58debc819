"""Session settings. Everything here is a default that a cluster may override."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    # Series work is heavy per byte: coalesce by parallelism, not up to a megabyte.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32KB",
    # Call-site capture costs several driver round trips per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A row handed to Python is a whole series, so batches are counted in series.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(app: str = "thinmarket", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streaming state.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests on one
    machine) a fresh local folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files as they end. By default these stay on disk until
    the driver happens to collect garbage, and a job of many writes holds the shuffles of all of them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


REUSE_LIMIT_BYTES = 16 * 1024**3


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def reuse(df: DataFrame, one_row_per: DataFrame | None = None, widening: int = 4) -> DataFrame:
    """Keeps a table that one session reads many times, if its estimated size is within bounds.

    Without statistics a join may be estimated as the product of its sides, which no bound meets. A
    table with at most one row for each of another's is therefore measured by that one, ``widening``
    times for the columns that joins have added.

    Beyond the bound the plan is left as it is: such a table belongs in storage, written once by
    ``sources.sinks``, and is then read with pruning like any other. Lost blocks are recomputed.
    """
    size = estimated_bytes(df) if one_row_per is None else estimated_bytes(one_row_per) * widening
    return df.persist(StorageLevel.MEMORY_AND_DISK) if size <= REUSE_LIMIT_BYTES else df
