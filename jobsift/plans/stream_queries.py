"""Registered streaming / upgrade / multi-source queries (O-T1 … O-T4, O-U1, O-A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import report as R
from ..session import read_table
from ..streaming import stream as ST
from . import extension_queries as XQ
from . import extract_queries as SQ
from . import page_queries as PQ
from ..functions import urls as URL
from ..sources import listings as L


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def q_stream_dedup(spark, sf_dir):
    """O-T1/O-T2: documents streamed through the dedup state; the set of surviving keys."""
    return ST.stream_dedup_documents(spark, f"{sf_dir}/documents.parquet", _docs(spark, sf_dir).schema).select("fp").distinct()


def q_upgrade_longest(spark, sf_dir):
    """O-T4 (batch): per source the capture with the longest text, ties to the earliest doc."""
    caps = _docs(spark, sf_dir).select(F.col("source").alias("url"), F.col("doc_id").alias("capture_no"), F.col("text").alias("description"))
    return E.upgrade_longest(caps, "url", "capture_no").select("url", "capture_no")


def q_stream_upgrade(spark, sf_dir):
    """O-T4 (streaming, update-mode aggregation) — same answer as the batch rule."""
    return ST.stream_upgrade_documents(spark, f"{sf_dir}/documents.parquet", _docs(spark, sf_dir).schema).select("url", "capture_no")


def q_stream_pages(spark, sf_dir):
    """O-T1: the crawl streamed through the shredder and the heading selectors into files."""
    pages = ST.table_stream(spark, f"{sf_dir}/pages.parquet", ST.PAGES_DDL)
    return ST.drain_append(PQ.page_headings(ST.stream_nodes(pages)), "stream_pages")


def q_stream_status(spark, sf_dir):
    """O-T3: running page counts per detected source."""
    pages = ST.table_stream(spark, f"{sf_dir}/pages.parquet", ST.PAGES_DDL)
    return ST.drain_upsert(ST.running_status(pages.select(URL.detect_source("url").alias("source"))), ["source"], "stream_status")


def q_upgrade_if_short(spark, sf_dir):
    """O-T4 (batch-coordinator rule): the second capture replaces a first one of ≤ 100 chars."""
    caps = _docs(spark, sf_dir).select(F.col("source").alias("url"), F.col("doc_id").alias("capture_no"), F.col("text").alias("description"))
    return E.upgrade_if_short(caps, "url", "capture_no").select("url", "capture_no")


def q_sites_summary(spark, sf_dir):
    """O-U1 + O-A1: Indeed, LinkedIn and Naukri runs unioned, then summarised."""
    runs = [
        SQ.dedup_role_company(SQ.site_jobs(L.indeed_pages(spark, sf_dir), "Indeed")),
        SQ.dedup_role_company(SQ.site_jobs(L.linkedin_pages(spark, sf_dir), "LinkedIn")),
        SQ.dedup_role_company(SQ.site_jobs(L.naukri_pages(spark, sf_dir), "Naukri", prefer="cards")),
    ]
    return R.summary(E.union_runs(*runs))


def q_batch_status(spark, sf_dir):
    """O-A6 for the extension batch over the Naukri listing links."""
    links = XQ._links(XQ.shred_pages(L.naukri_pages(spark, sf_dir)), XQ.X.naukri_links)
    return R.batch_status(E.visited(links, XQ.job_page_records(spark, sf_dir, crawled_only=True)))
