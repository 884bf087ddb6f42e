"""Spark session helpers.

The library never creates a cluster session on its own: jobs take the
``SparkSession`` they are given.  ``local_session`` exists for tests, the
bench and the driver smoke check only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Pages are large rows (whole HTML documents): keep Arrow batches small so a
# Python worker never holds thousands of multi-megabyte pages at once.
ARROW_BATCH_ROWS = 256


#: Session setting: partitions over which a scan's rows are dealt before CPU-heavy work (unset: as scanned).
SCAN_PARTITIONS = "spark.jobsift.scanPartitions"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "jobsift") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("JOBSIFT_DRIVER_MEMORY", "16g"))
        .config(SCAN_PARTITIONS, str(2 * shuffle_partitions))  # the test tables are single parquet row groups
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Settings every job relies on; safe to call on a cluster session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    # extractor Columns nest many lambda scopes; resolution needs more passes
    spark.conf.set("spark.sql.analyzer.maxIterations", "1000")
    spark.conf.set("spark.sql.optimizer.maxIterations", "1000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    ensure_checkpoint_dir(spark)


def is_local(master: str) -> bool:
    """Driver and executors are one process (``local``, ``local[8]``), so they share local folders."""
    return master == "local" or master.startswith("local[")


def store(df, name: str):
    """Write ``df`` once as parquet in the shared folder and return it as read back.

    Cuts lineage, runs the plan once however many passes follow, and fixes
    whatever depends on the partition a row lay in.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage configured by the
    operator; it is read from the session and never replaced.  Where it is
    unset, a local master (tests, bench) gets a private temporary folder and
    any other master an error: executors don't share the driver's disk.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not is_local(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="jobsift-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
