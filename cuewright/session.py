"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

ROWS_PER_TASK = "cuewright.rowsPerTask"
BROADCAST_ROWS = "cuewright.broadcastRows"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# Python workers outlive their tasks: blocks of a MB and more go back to the system when they are freed.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def build_session(master: str = "local[*]", partitions: int = 8, **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName("cuewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Only matters for small inputs: large ones are merged towards the advisory size.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def rows_per_task(spark: SparkSession) -> int:
    """Most rows of one group that a single window or grouped task may hold."""
    return int(spark.conf.get(ROWS_PER_TASK, "1000000"))


def broadcast_rows(spark: SparkSession) -> int:
    """Most rows a dimension may have and still be broadcast."""
    return int(spark.conf.get(BROADCAST_ROWS, "200000"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session may do without one and gets a temporary folder."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast hint for a side within the bound; a larger one is left to shuffle.

    At most one row more than the bound is counted.
    """
    bound = broadcast_rows(df.sparkSession)
    return broadcast(df) if df.limit(bound + 1).count() <= bound else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over the cores where the input has fewer splits than there are cores.

    Meant for costly row-wise work on small inputs; a large table has splits enough and is
    left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this application the package and their memory settings, once.

    Executors get an archive; the driver's own streaming worker reads the import path instead. A
    session that sets no size of Arrow batches gets 4 MB, as long texts fill memory before 10,000 rows.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = f"{here}{os.pathsep}{known}" if known else here
    for name, value in WORKER_MEMORY.items():
        context.environment.setdefault(name, value)
    folder = tempfile.mkdtemp(prefix="spark-")
    context.addPyFile(shutil.make_archive(f"{folder}/cuewright", "zip", here, "cuewright"))
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
