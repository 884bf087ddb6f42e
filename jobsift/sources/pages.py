"""O-C1 page scan and the shredded-node table.

Pages are read column-pruned (``page_id, url, html``).  Every page is
shredded; the length rule belongs to the Naukri engine and reads the node
table's ``html_len``.  At scale the shredded table is written once (silver) and
every extractor reads it back: the Python step never re-runs per query.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import MIN_USABLE_HTML
from ..session import SCAN_PARTITIONS, store
from .shred import shred


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read crawled pages; parquet (default), json, or a folder of html files (``wholetext``)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        df = spark.read.schema("page_id BIGINT, url STRING, html STRING").json(path)
    elif fmt == "html":
        raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.input_file_name().alias("url"))
        df = raw.select(F.xxhash64("url").alias("page_id"), "url", "html")
    else:
        raise ValueError(f"unknown page format {fmt!r}")
    return df.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))


def spread(rows: DataFrame) -> DataFrame:
    """Deal scanned rows over as many partitions as the session's ``SCAN_PARTITIONS`` says.

    Parsing and extraction cost CPU per byte, and a parquet row group can't be
    split by the scan.  Whoever reads a few large row groups sets the number;
    unset, as on a large crawl, rows stay where they were read.
    """
    n = rows.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return rows.repartition(int(n)) if n else rows


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows from which pages are built over the whole cluster, at random or by ``keys``.

    A short row becomes a page whose parsing costs a thousand times its scan, so
    neither the file splits nor the sizes that adaptive execution sees tell how many
    tasks the pages need.
    """
    spark = rows.sparkSession
    n = spark.conf.get(SCAN_PARTITIONS, None) or max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(int(n), *keys)


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_pages(spark, os.path.join(sf_dir, "pages.parquet")))


def usable_nodes(nodes: DataFrame) -> DataFrame:
    """O-C2, a rule of the Naukri engine only: pages of at least 500 characters."""
    return nodes.where(F.col("html_len") >= MIN_USABLE_HTML)


def shred_pages(pages: DataFrame) -> DataFrame:
    """Every page, whatever its length; a page that can't be read keeps a row with its ``shred_error``."""
    return shred(pages)


def shred_once(pages: DataFrame) -> DataFrame:
    """The node table, stored in the shared folder: queries with several branches parse each page once."""
    return store(shred_pages(pages), "nodes")


def write_nodes(nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the silver node table; readers get column pruning on ``buf``/``nodes``."""
    nodes.write.mode(mode).parquet(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Read a silver node table written by :func:`write_nodes`."""
    return spark.read.parquet(path)


def shred_to_silver(pages: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Job 1 of a run: shred → parquet; returns the stored table.

    Extractors then read ``path`` (column-pruned to ``url, buf, nodes``), so
    the Python step runs once per page however many extractors follow, and a
    lost executor never re-parses HTML for a later stage.
    """
    write_nodes(shred_pages(spread(pages)), path, mode)
    return read_nodes(pages.sparkSession, path)
