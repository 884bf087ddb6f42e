"""Registered extraction queries over listing pages derived from part/supplier/nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup
from ..operators import extract_sites as X
from ..operators import report as R
from ..operators.jobs import explode_jobs, flat
from ..sources import listings as L
from ..sources.pages import shred_once, shred_pages, usable_nodes



def site_jobs(pages, site: str, **opts):
    return site_jobs_nodes(shred_pages(pages), site, **opts)


def site_jobs_nodes(nodes, site: str, **opts):
    B, N, U = F.col("buf"), F.col("nodes"), F.col("url")
    if site == "Indeed":
        items = X.indeed_jobs(U, B, N)
    elif site == "LinkedIn":
        items = X.linkedin_jobs(U, B, N)
    elif site == "Naukri":
        nodes = usable_nodes(nodes)
        items = X.naukri_jobs(B, N, **opts)
    else:
        raise ValueError(site)
    return explode_jobs(nodes, items, single=True)


def dedup_role_company(jobs):
    """O-D1 over a whole run: first (page_id, pos) per fingerprint(job_role + company); single-job pages stay."""
    key = F.when(F.col("single"), dedup.page_key()).otherwise(F.concat(F.lit("F|"), dedup.role_company_key("job_role", "company")))
    return dedup.first_per_key(jobs.withColumn("fp", key), "fp", ["page_id", "pos"]).drop("fp", "single")


def q_extract_indeed(spark, sf_dir):
    jobs = dedup_role_company(site_jobs(L.indeed_pages(spark, sf_dir), "Indeed"))
    return flat(jobs, ["page_id", "pos", "company", "job_role", "description", "description_bullets", "location", "link"])


def q_extract_linkedin(spark, sf_dir):
    jobs = dedup_role_company(site_jobs(L.linkedin_pages(spark, sf_dir), "LinkedIn"))
    return flat(jobs, ["page_id", "pos", "company", "job_role", "description", "description_bullets", "location", "link"])


NAUKRI_COLS = ["page_id", "pos", "company", "job_role", "description", "description_bullets", "skills", "location", "experience"]


def q_extract_naukri(spark, sf_dir):
    """Naukri listing cards (``prefer='cards'``), then the wrapper's role+company dedup."""
    jobs = dedup_role_company(site_jobs(L.naukri_pages(spark, sf_dir), "Naukri", prefer="cards"))
    return flat(jobs, NAUKRI_COLS)


def q_naukri_single(spark, sf_dir):
    """The reference rule (single page first) on the same listing pages."""
    jobs = dedup_role_company(site_jobs(L.naukri_pages(spark, sf_dir), "Naukri", prefer="single"))
    return flat(jobs, NAUKRI_COLS)


# fixed values
INDEED_EMPTY = "No job cards extracted from Indeed page."
LINKEDIN_EMPTY = "No job listings extracted from search page."
INDEED_UNPARSED = "Could not parse job details from Indeed viewjob page."
LINKEDIN_UNPARSED = "Could not parse job details from single LinkedIn page."


def site_outcomes(pages, site: str):
    """O-A2 of an Indeed or LinkedIn run: cards found, rows kept after the run-wide dedup."""
    found_fn, single_fn, empty, unparsed = {
        "Indeed": (X.indeed_found, X.indeed_is_single, INDEED_EMPTY, INDEED_UNPARSED),
        "LinkedIn": (X.linkedin_found, X.linkedin_is_single, LINKEDIN_EMPTY, LINKEDIN_UNPARSED),
    }[site]
    nodes = shred_once(pages)
    url, buf, tree = F.col("url"), F.col("buf"), F.col("nodes")
    found = nodes.select("page_id", found_fn(url, buf, tree).alias("total_found"), single_fn(url, tree).alias("single"))
    return R.outcomes(R.unread(nodes), found, dedup_role_company(site_jobs_nodes(nodes, site)), site, empty, unparsed)


def q_site_outcomes(spark, sf_dir):
    """The Indeed and LinkedIn runs over their listing pages."""
    out = None
    for k, (builder, site) in enumerate([(L.indeed_pages, "Indeed"), (L.linkedin_pages, "LinkedIn")]):
        pages = builder(spark, sf_dir).select((F.col("page_id") * 2 + k).alias("page_id"), "url", "html")
        o = site_outcomes(pages, site)
        out = o if out is None else out.unionByName(o)
    return out
