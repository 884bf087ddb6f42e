"""Input classification (O-C2, O-C3, O-C11 … O-C15, O-A4).

All rules are per-page Column expressions over the shredded node array, so
classification is a narrow (shuffle-free) projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls as U
from . import select as S

MIN_USABLE_HTML = 500


def usable(html) -> Column:
    """O-C2: html present and at least 500 characters."""
    h = F.col(html) if isinstance(html, str) else html
    return h.isNotNull() & (F.length(h) >= MIN_USABLE_HTML)


def blocked(body) -> Column:
    """O-C3 (first script): ``captcha``, ``verify you are human`` or ``blocked``."""
    low = F.lower(F.col(body) if isinstance(body, str) else body)
    return (F.instr(low, "captcha") > 0) | (F.instr(low, "verify you are human") > 0) | (F.instr(low, "blocked") > 0)


def blocked_v2(body) -> Column:
    """O-C3 (second script): ``captcha`` or ``verify``."""
    low = F.lower(F.col(body) if isinstance(body, str) else body)
    return (F.instr(low, "captcha") > 0) | (F.instr(low, "verify") > 0)


def url_path(url) -> Column:
    """``location.pathname`` (path without query and fragment)."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_query(url) -> Column:
    """``location.search`` (from '?' up to the fragment, '' when absent)."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#]*(\\?[^#]*)", 1)


def naukri_is_listing(nodes: Column, url: Column) -> Column:
    """O-C11 listing: at least 2 of 6 signals."""
    signals = [
        S.count(nodes, 'a[href*="/job-listings"]') >= 2,
        S.count(nodes, 'a[href*="-jobs-careers-"]') >= 2,
        S.count(nodes, 'div[class*="cust-job-tuple"], div[class*="sjw__tuple"], div[class*="jobTuple"]') >= 2,
        S.count(nodes, 'div[class*="srp-"], div[class*="search-result"]') >= 2,
        S.count(nodes, '[class*="pagination"], [aria-label*="pagination"]') >= 1,
        (F.instr(url_path(url), "/jobs/") > 0) | (F.instr(url_query(url), "k=") > 0),
    ]
    return sum(F.when(s, 1).otherwise(0) for s in signals) >= 2


def naukri_is_job(nodes: Column, url: Column) -> Column:
    """O-C11 job page: at least 2 of 4 signals."""
    signals = [
        F.instr(url_path(url), "/job-listings") > 0,
        F.instr(url_path(url), "/job-details") > 0,
        S.count(nodes, '[class*="jd-header"], [class*="styles_jd-header"], [class*="job-header"]') >= 1,
        (S.count(nodes, "h1") >= 1) & (S.count(nodes, '[class*="description"]') >= 1),
    ]
    return sum(F.when(s, 1).otherwise(0) for s in signals) >= 2


GENERIC_JOB_LINKS = 'a[href*="/job"], a[href*="/career"], a[href*="/position"], a[href*="/vacancy"]'


def generic_is_listing(nodes: Column) -> Column:
    """O-C12 listing: at least 3 job-like links."""
    return S.count(nodes, GENERIC_JOB_LINKS) >= 3


def generic_is_job(nodes: Column) -> Column:
    """O-C12 job page: a title heading and a description element."""
    return (S.count(nodes, 'h1, h2[class*="title"]') >= 1) & (
        S.count(nodes, '[class*="description"], [class*="job-detail"], #jobDescriptionText') >= 1
    )


def extension_site(url) -> Column:
    """O-C13: only a naukri.com hostname uses the Naukri rules."""
    return F.when(U.host_contains(url, "naukri.com"), F.lit("naukri")).otherwise(F.lit("generic"))


def page_type(nodes: Column, url: Column, has_links: Column | None = None) -> Column:
    """O-C13: job beats listing beats unknown; a listing with links is ``listing-with-links``."""
    site = extension_site(url)
    is_job = F.when(site == "naukri", naukri_is_job(nodes, url)).otherwise(generic_is_job(nodes))
    is_listing = F.when(site == "naukri", naukri_is_listing(nodes, url)).otherwise(generic_is_listing(nodes))
    listing = F.lit("listing") if has_links is None else F.when(has_links, F.lit("listing-with-links")).otherwise(F.lit("listing"))
    return F.when(is_job, F.lit("job")).when(is_listing, listing).otherwise(F.lit("unknown"))


def link_pattern(href) -> Column:
    """O-C14: job-listings / filter-jobs / company / other; NULL = not counted."""
    h = F.coalesce(F.col(href) if isinstance(href, str) else href, F.lit(""))
    return (
        F.when(F.instr(h, "/job-listings") > 0, F.lit("job-listings"))
        .when((F.instr(h, "/ai-jobs") > 0) | h.endswith("-jobs"), F.lit("filter-jobs"))
        .when(F.instr(F.lower(h), "company") > 0, F.lit("company"))
        .when((F.length(h) > 5) & h.startswith("/"), F.lit("other"))
    )


def sample_link(href) -> Column:
    """O-C15: non-empty href that is neither a fragment nor ``javascript…``."""
    h = F.coalesce(F.col(href) if isinstance(href, str) else href, F.lit(""))
    return (h != "") & ~h.startswith("#") & ~h.startswith("javascript")
