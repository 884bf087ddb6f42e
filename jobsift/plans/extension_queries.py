"""Registered extension-batch queries: job links, job pages, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import extract_extension as X
from ..operators.jobs import flat
from ..sources import listings as L
from ..sources.pages import shred_once, shred_pages

B, N, U = "buf", "nodes", "url"


def _links(nodes, fn):
    exploded = nodes.select("page_id", F.posexplode_outer(fn(F.col(U), F.col(B), F.col(N))).alias("i", "l")).where(F.col("l").isNotNull())
    return exploded.select("page_id", (F.col("i") + 1).cast("int").alias("pos"), "l.url", "l.company", "l.role")


def q_naukri_links(spark, sf_dir):
    return _links(shred_pages(L.naukri_pages(spark, sf_dir)), X.naukri_links)


def q_generic_links(spark, sf_dir):
    return _links(shred_pages(L.generic_link_pages(spark, sf_dir)), X.generic_links)


def q_script_links(spark, sf_dir):
    return _links(shred_pages(L.naukri_pages(spark, sf_dir)), lambda u, b, n: X.script_links(b, n))


def job_page_records(spark, sf_dir, crawled_only: bool = False):
    """Content script over every job page; accepted records only."""
    nodes = shred_pages(L.naukri_job_pages(spark, sf_dir, crawled_only))
    scraped = nodes.select("page_id", "url", X.scrape_page(F.col(U), F.col(B), F.col(N), with_links=False).alias("r"))
    rec = scraped.select("page_id", "url", "r.page_type", F.explode_outer("r.data").alias("d")).where(F.col("d").isNotNull())
    return rec.select("page_id", "url", "page_type", "d.*").drop("link")


JOB_PAGE_COLS = [
    "page_id", "page_type", "company", "job_role", "description", "description_bullets", "skills", "location", "experience",
    "education", "employment_type", "department", "industry", "highlights", "source",
]


def q_naukri_job_page(spark, sf_dir):
    return flat(job_page_records(spark, sf_dir), JOB_PAGE_COLS)


def q_script_job_page(spark, sf_dir):
    nodes = shred_pages(L.naukri_job_pages(spark, sf_dir))
    r = nodes.select("page_id", X.script_job_page(F.col(B), F.col(N)).alias("r"))
    return r.select("page_id", "r.company", "r.role", F.col("r.desc_len").cast("int").alias("desc_len"), F.array_join("r.skills", "\n").alias("skills"))


def _batch(spark, sf_dir):
    links = _links(shred_pages(L.naukri_pages(spark, sf_dir)), X.naukri_links)
    return E.batch(links, job_page_records(spark, sf_dir, crawled_only=True))


RESULT_COLS = ["page_id", "pos", "url", "company", "job_role", "description", "description_bullets", "skills", "education",
               "employment_type", "department", "industry", "source"]


def q_enrich_links(spark, sf_dir):
    res, _ = _batch(spark, sf_dir)
    return flat(res, RESULT_COLS)


def q_enrich_errors(spark, sf_dir):
    _, err = _batch(spark, sf_dir)
    return err


def q_extension_page_types(spark, sf_dir):
    """O-C11 + O-C13: the content script's page type on Naukri listing pages and job pages."""
    listing = L.naukri_pages(spark, sf_dir).select((F.col("page_id") * 2).alias("page_id"), "url", "html")
    jobs = L.naukri_job_pages(spark, sf_dir).select((F.col("page_id") * 2 + 1).alias("page_id"), "url", "html")
    nodes = shred_once(listing.unionByName(jobs))
    r = nodes.select("page_id", X.scrape_page(F.col(U), F.col(B), F.col(N)).alias("r"))
    return r.select("page_id", "r.page_type", F.size("r.links").cast("int").alias("n_links"), F.size("r.data").cast("int").alias("n_data"))
