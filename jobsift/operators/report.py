"""Run summaries, per-page outcomes, preview and serial numbers (O-A*, O-L*, O-W1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store

ID_BITS = 33  # monotonically_increasing_id: partition id in the upper 31 bits


def summary(jobs: DataFrame, approx: bool = False) -> DataFrame:
    """O-A1: entries, distinct companies, distinct roles, sources joined by ', ' (sorted)."""
    cd = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return jobs.agg(
        F.count("*").cast("bigint").alias("total_entries"),
        cd("company").cast("bigint").alias("companies"),
        cd("job_role").cast("bigint").alias("job_roles"),
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"),
    )


FETCH_FAILED = "Page fetch failed or empty"  # fixed value


def outcomes(pages: DataFrame, found: DataFrame, kept: DataFrame, source: str, empty_message: str, single_message: str | None = None) -> DataFrame:
    """O-A2: per page ``total_found``, ``total_new``, ``success`` and an error message.

    ``found`` = (page_id, total_found[, single]); ``kept`` = deduplicated job rows.
    Pages without rows keep an outcome row (left joins on ``page_id``).  A page
    whose row in ``pages`` says ``rejected`` (empty, unreadable, too short for
    its engine) gets the fetch message, an unparsed single-job page its own.
    """
    new = kept.groupBy("page_id").agg(F.count("*").cast("int").alias("total_new"))
    rejected = F.col("rejected") if "rejected" in pages.columns else F.lit(False)
    out = pages.select("page_id", rejected.alias("rejected")).join(found, "page_id", "left").join(new, "page_id", "left")
    total_new = F.coalesce(F.col("total_new"), F.lit(0))
    single = F.coalesce(F.col("single"), F.lit(False)) if "single" in found.columns else F.lit(False)
    message = (
        F.when(total_new > 0, F.lit("")).when(F.col("rejected"), F.lit(FETCH_FAILED))
        .when(single, F.lit(single_message or empty_message)).otherwise(F.lit(empty_message))
    )
    return out.select(
        "page_id", F.lit(source).alias("source"),
        (total_new > 0).alias("success"),
        F.coalesce(F.col("total_found"), F.lit(0)).cast("int").alias("total_found"),
        total_new.alias("total_new"), message.alias("error_message"),
    )


def unread(nodes: DataFrame, least: int = 1) -> DataFrame:
    """(page_id, rejected): pages that gave an error or have fewer than ``least`` characters."""
    return nodes.select("page_id", (F.col("shred_error").isNotNull() | (F.col("html_len") < least)).alias("rejected"))


def preview(jobs: DataFrame, n: int = 10, order=("page_id", "pos")) -> DataFrame:
    """O-L1: the first ``n`` rows in run order (a top-k: ``TakeOrderedAndProject``)."""
    return jobs.orderBy(*order).limit(n)


def more_count(jobs: DataFrame, n: int = 10) -> DataFrame:
    """O-L1: "... and N more entries"."""
    return jobs.agg(F.greatest(F.count("*") - n, F.lit(0)).cast("bigint").alias("more"))


def serial_number(df: DataFrame, order: list[str], name: str = "s_no") -> DataFrame:
    """O-W1: 1…n in ``order`` without a single-partition window.

    Range-partition and sort by ``order`` (one shuffle) and store the rows once
    with the number that ``monotonically_increasing_id`` gives them (partition,
    place in it).  Partition totals and the numbering both read the stored
    rows, so they see the same partitions whatever adaptive execution or a
    retry does.  Only the offsets are broadcast: one row per partition.  Rows
    that are equal in ``order`` get consecutive numbers in no fixed order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    placed = store(placed, "numbered").withColumn("_pid", F.shiftrightunsigned("_mid", ID_BITS))
    counts = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_mid").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    numbered = placed.join(F.broadcast(offsets), "_pid").withColumn(name, (F.col("_off") + place + 1).cast("bigint"))
    return numbered.drop("_mid", "_pid", "_off")


def batch_status(visited: DataFrame) -> DataFrame:
    """O-A6: results, errors, processed = results + errors of ``total`` valid links, and
    percent = min(100, round(100 · processed / total)), 0 for no links.  One aggregation
    over the visited links (:func:`..enrich.visited`)."""
    t = visited.agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome") == "result").alias("results"), F.count_if(F.col("outcome") == "error").alias("errors")
    ).withColumn("processed", F.col("results") + F.col("errors"))
    percent = F.when(F.col("total") > 0, F.round(F.col("processed") * 100.0 / F.col("total"))).otherwise(F.lit(0.0))
    return t.select("processed", "total", "results", "errors", F.least(F.lit(100), percent).cast("int").alias("percent"))
