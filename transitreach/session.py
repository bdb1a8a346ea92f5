"""Session helpers.

Library functions never change session settings (but for the time of a write,
``shuffle_files_dropped``); they work under the
defaults of Spark 4 (ANSI mode on, AQE on).  ``get_session`` is only a
convenience for tests, the bench and local runs.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings for a local run.  On a cluster the same keys are sized to the data:
# shuffle partitions ~ total shuffle bytes / 128 MB, AQE coalesces the rest.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # one machine lists folders faster on the driver than with a listing job
    # of one task per folder; on a cluster the default (parallel listing past
    # 32 paths) is kept, since object-store listings are slow per call
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "4096",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def is_local(master: str | None) -> bool:
    """Whether tasks run in the driver's process (``local``, ``local[8]``; not ``local-cluster``)."""
    return master == "local" or (master or "").startswith("local[")


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "transitreach", driver_memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if is_local(master):
        # a local master runs every task in the driver JVM: give it the heap
        builder = builder.config("spark.driver.memory", driver_memory)
        for key, value in LOCAL_CONF.items():
            builder = builder.config(key, value)
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` (or the SparkContext's directory); only when
    neither is set and the master is local -- a test session -- a folder under the
    system temporary directory is configured.  On a cluster executors would not see
    such a folder, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="transitreach-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, for written tables."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Within it, a finished job's shuffle files go at once, not when the driver happens to collect its garbage.

    For writing tables: they are read back, so nothing asks for those files again.  The session has its own
    setting back afterwards.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python-side code can open a local path."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


__all__ = ["get_session", "ensure_checkpoint_dir", "scratch_path", "shuffle_files_dropped", "local_path", "LOCAL_CONF"]
