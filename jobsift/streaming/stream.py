"""Structured Streaming jobs (O-T1 … O-T4).

* O-T1 incremental page processing: a file-source stream of crawled pages
  goes through the same shred + extractor Columns as the batch job
  (``mapInArrow`` and higher-order functions are stateless, so they stream).
* O-T2 stateful dedup: ``dropDuplicates`` on the fingerprint (state lives
  for the query's life, like the reference's process-wide seen-set) or,
  with an ingestion-time watermark, ``dropDuplicatesWithinWatermark`` to
  bound the state.
* O-T3 running status: a streaming ``groupBy(source).count()``.
* O-T4 re-extraction upgrade: per url keep the capture with the longest
  description — a streaming ``max_by`` aggregation in update mode.

Results end in parquet files and state in RocksDB; result and checkpoint
folders live under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..operators import dedup
from ..session import ensure_checkpoint_dir
from ..sources.shred import shred

PAGES_DDL = "page_id BIGINT, url STRING, html STRING"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def read_page_stream(spark: SparkSession, landing: str, max_files: int = 64) -> DataFrame:
    """O-T1: crawled pages arriving as parquet files in ``landing``."""
    return spark.readStream.schema(PAGES_DDL).option("maxFilesPerTrigger", max_files).parquet(landing)


def stream_nodes(pages: DataFrame) -> DataFrame:
    """Shred a page stream."""
    return shred(pages)


def stream_dedup(rows: DataFrame, key: str, event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """O-T2: keep the first row per key seen by the stream.

    Without ``horizon`` the key state is kept for the life of the query; with
    ``event_time``/``horizon`` it is dropped once the watermark passes.
    Within one micro-batch the surviving row is not ordered: equal to the
    batch job as a *set of keys*.
    """
    if horizon is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])


def running_status(rows: DataFrame, by: str = "source") -> DataFrame:
    """O-T3: running counts per source (complete or update mode)."""
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def stream_upgrade(captures: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """O-T4: per key the capture with the longest description (ties: earliest capture)."""
    best = captures.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(F.length(T.nz(F.col("description"))).alias("n"), (-F.col(order)).alias("o"))).alias("b")
    )
    return best.select(key, "b.*")


def rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB files (checkpointed to shared storage), not in executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def table_stream(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """A parquet table as a stream of its files.

    A stream takes a folder or a pattern; as a pattern, a table may also be a
    single file.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path[:-1]}[{path[-1]}]")


def drain_append(df: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run an append stream over everything available now into parquet files; returns them as a table."""
    spark = df.sparkSession
    rocksdb_state(spark)
    out = out or shared_path(spark, f"out-{name}")
    query = (df.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint or shared_path(spark, f"ckpt-{name}")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def drain_upsert(df: DataFrame, keys: list[str], name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run an update-mode aggregation over everything available now; returns each key's last row.

    Every micro-batch adds the rows that it changed as a folder of its own
    (a retried batch overwrites its folder), so nothing passes the driver; the
    last row per key is a map-side ``max_by`` over the batch number.
    """
    spark = df.sparkSession
    rocksdb_state(spark)
    out = out or shared_path(spark, f"out-{name}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (df.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint or shared_path(spark, f"ckpt-{name}")).trigger(availableNow=True).start())
    query.awaitTermination()
    changes = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(out)
    rest = [c for c in df.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*df.columns)


def stream_dedup_documents(spark: SparkSession, path: str, schema, name: str = "stream_dedup", max_files: int = 64) -> DataFrame:
    """Documents streamed through the O-D2 key and O-T2 dedup; the result is the set of keys."""
    keyed = table_stream(spark, path, schema, max_files).select(
        "doc_id", dedup.description_key(T.py_strip(T.nz(F.col("text"))), F.col("source")).alias("fp")
    )
    return drain_append(stream_dedup(keyed, "fp"), name)


def stream_upgrade_documents(spark: SparkSession, path: str, schema, name: str = "stream_upgrade", max_files: int = 64) -> DataFrame:
    """O-T4 on documents: captures of one ``source`` compete, the longest text wins."""
    caps = table_stream(spark, path, schema, max_files).select(
        F.col("source").alias("url"), F.col("doc_id").alias("capture_no"), F.col("text").alias("description")
    )
    return drain_upsert(stream_upgrade(caps, "url", "capture_no", ["capture_no", "description"]), ["url"], name)
