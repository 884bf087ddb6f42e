"""Registered run over a mixed crawl (all four extractors, routed per page)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import route
from ..operators import sinks as K
from ..operators.jobs import flat
from ..sources import listings as L
from ..sources.pages import shred_pages

BUILDERS = [L.indeed_pages, L.linkedin_pages, L.naukri_pages, L.mixed_pages]


def mixed_crawl(spark, sf_dir):
    """All listing layouts in one crawl; page ids are ``4 * supplier + layout``."""
    out = None
    for k, b in enumerate(BUILDERS):
        p = b(spark, sf_dir).select((F.col("page_id") * 4 + k).alias("page_id"), "url", "html")
        out = p if out is None else out.unionByName(p)
    return out


def q_routed_run(spark, sf_dir):
    jobs = route.run_routed(shred_pages(mixed_crawl(spark, sf_dir)))
    return flat(jobs, ["page_id", "pos", "source", "company", "job_role", "description"])


def _naukri_run(spark, sf_dir):
    from .extract_queries import dedup_role_company, site_jobs

    return dedup_role_company(site_jobs(L.naukri_pages(spark, sf_dir), "Naukri", prefer="cards"))


def q_export_sheet_engine(spark, sf_dir):
    """O-P1b: the listing engine's sheet (no skill tagging, blanks kept, source default Naukri)."""
    return K.sheet(_naukri_run(spark, sf_dir), variant="engine").drop("page_id", "pos")


def q_export_json_engine(spark, sf_dir):
    """O-K2: the listing engine's JSON documents (url kept, default skills)."""
    docs = K.json_docs(_naukri_run(spark, sf_dir), variant="engine")
    return docs.withColumn("requiredSkills", F.array_join("requiredSkills", "|"))
