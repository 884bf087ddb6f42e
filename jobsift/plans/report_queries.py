"""Registered report and export queries over a generic run of Spark-built pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract_generic as G
from ..operators import report as R
from ..operators import sinks as K
from ..operators.jobs import explode_jobs
from ..session import read_table
from ..sources import listings as L
from ..sources.pages import shred_once
from .generic_queries import generic_run, generic_run_nodes

LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
NO_DATA = "Could not automatically detect company/job data on this page. Try using the 'Custom CSS Selectors' option in Advanced Settings."


def _run(spark, sf_dir):
    return generic_run(L.mixed_pages(spark, sf_dir))


def q_summary(spark, sf_dir):
    return R.summary(_run(spark, sf_dir))


def q_outcomes(spark, sf_dir):
    """O-A2: found = items of the winning strategy, new = rows left after post-processing and dedup."""
    pages = L.mixed_pages(spark, sf_dir)
    nodes = shred_once(pages)
    found = nodes.select("page_id", F.size(G.heuristic_items(F.col("buf"), F.col("nodes"))).alias("total_found"))
    return R.outcomes(nodes.select("page_id"), found, generic_run_nodes(nodes), "Generic", NO_DATA)


def q_preview(spark, sf_dir):
    return R.preview(_run(spark, sf_dir)).select("page_id", "pos", "company", "job_role")


def q_export_sheet(spark, sf_dir):
    return K.sheet(_run(spark, sf_dir)).drop("page_id", "pos")


def q_export_csv(spark, sf_dir):
    return K.csv_rows(_run(spark, sf_dir)).drop("page_id", "pos")


def q_export_json(spark, sf_dir):
    docs = K.json_docs(_run(spark, sf_dir))
    return docs.withColumn("requiredSkills", F.array_join("requiredSkills", "|"))


def q_serial_lineitem(spark, sf_dir):
    """O-W1 over a table with no unique key: all its columns order it, so equal rows are alike."""
    rows = read_table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    return R.serial_number(rows, LINE_COLUMNS)


def flagship(spark, sf_dir):
    """Listing pages → shred → strategy cascade → post-processing → dedup → 8-column sheet."""
    return K.sheet(_run(spark, sf_dir))
