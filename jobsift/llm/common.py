"""Helpers shared by the operators: session settings, tables kept in the
cluster's shared folder, and columns that can't clash with the caller's."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, read_table

#: Rows of an Arrow batch; texts are kilobytes, so a batch stays near a megabyte.
BATCH_ROWS = 256
#: Bytes of an Arrow batch: long texts make smaller batches.
BATCH_BYTES = 8 << 20
#: ASCII white space of the contracts, as a Java and RE2 regular expression.
WS = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of up to ``n`` rows for the actions within."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(prepare(spark), sf_dir, name)


class Staged:
    """Tables that one operator keeps in the folder of ``spark.checkpoint.dir``.

    A stored table cuts lineage (a lost executor costs its own tasks only),
    fixes ids given by partition, and lets a join see both sides as plain
    exchanges, which adaptive execution can split when a key is hot.
    ``drop`` deletes tables that later ones have replaced; tables that the
    operator's lazy result reads stay until the caller clears the folder.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = prepare(spark)
        self.root = f"{ensure_checkpoint_dir(spark)}/{operator}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._staged = self  # the table's owner lives as long as its frame
        return out

    def adopt(self, derived: DataFrame, stored: DataFrame) -> None:
        """``derived`` reads nothing but ``stored`` and is dropped with it."""
        self.paths[id(derived)] = self.paths[id(stored)]
        derived._staged = (self, stored)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(t)])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def utf8(text: str = "text") -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return text_or_empty(text).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores where the table has such a column (case-blind)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
