"""Session construction and the shared checkpoint folder.

Every job in the package takes a ``SparkSession``; this module only builds one
for tests, the bench and the command line, with the settings the plans rely on:
adaptive execution (runtime re-planning, partition coalescing, skew-join
splitting), UTC session time and no web UI.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Coalesced shuffle partitions stay small enough that CPU-heavy per-row
    # stages (statement parsing) use every core on small inputs. On a cluster,
    # set spark.sql.adaptive.advisoryPartitionSizeInBytes (e.g. 128m) with
    # parallelismFirst=false instead.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # Checkpoint files of DataFrames that are no longer referenced are removed,
    # and the cleaner's JVM collection runs often enough (default: 30 min) for
    # a long pipeline's dead checkpoints, shuffles and broadcasts to go away
    # between stages instead of piling up.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.cleaner.periodicGC.interval": "15s",
    # Joins broadcast a side only when its measured size is under this
    # threshold (Spark checks the size; above it the plan falls back to a
    # shuffle join). 32 MB keeps every dimension of the test data in memory
    # and still refuses a fact-sized side.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "shapecast", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for ``DataFrame.checkpoint`` and written state.

    On a cluster this is ``spark.checkpoint.dir`` (a folder every executor can
    reach). Only a local session without that setting gets a private folder
    under /tmp, which is what the tests use.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder "
                           "shared by the driver and every executor")
    folder = tempfile.mkdtemp(prefix="shapecast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def state_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for tables a job writes itself."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df):
    """Checkpoint ``df`` into the shared checkpoint folder (reliable, not local)
    and continue from the written copy.

    Used at stage boundaries of the pipeline (the log, the training rows, the
    scored versions, range-sorted rank inputs): later steps read the written
    data instead of recomputing its shuffles, plans stay small, and a lost
    executor costs a re-read rather than a re-run of everything upstream.
    (Measured at sf0.1: faster than writing and re-reading a Parquet table.)
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a task that is run again and again: fewer do not pay for starting it
#: and for what it passes on; more only where every core has work.
LEAST_ROWS, MOST_ROWS = 2048, 65536


def even_tasks(spark, rows: int) -> int:
    """Tasks to deal the rows of an iterative job to. Each pass starts them all,
    so their number follows the rows and the cores, not the shuffle partitions."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(cores, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS))


_STAGES: dict = {}


def stage(spark, key: tuple, build):
    """A materialized stage table reused by later queries of the same
    application (e.g. the log or the training rows of one data folder).
    ``reset_stages`` forgets them (the bench does, between queries)."""
    full = (spark.sparkContext.applicationId,) + tuple(key)
    if full not in _STAGES:
        _STAGES[full] = materialize(build())
    return _STAGES[full]


def reset_stages() -> None:
    _STAGES.clear()
