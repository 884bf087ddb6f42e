"""Extractor routing (O-C9, O-E1, O-E2, O-X23).

One projection routes every page to its site extractor by the detected
source (a lazy ``CASE``: only the matching extractor runs for a row), so a
mixed crawl is processed in a single pass with no per-source scans.
"""

from __future__ import annotations

from collections.abc import Callable

from .memo import cached_column

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from . import dedup
from . import extract_generic as G
from . import extract_sites as X
from .classify import MIN_USABLE_HTML
from .jobs import explode_jobs

# O-E1 / O-E2: the extractor registry, source → Column function of (url, buf, nodes, custom selectors)
REGISTRY = {
    "Indeed": lambda url, buf, nodes, custom=None: X.indeed_jobs(url, buf, nodes),
    "LinkedIn": lambda url, buf, nodes, custom=None: X.linkedin_jobs(url, buf, nodes),
    "Naukri": lambda url, buf, nodes, custom=None: X.naukri_jobs(buf, nodes),
    "Generic": lambda url, buf, nodes, custom=None: G.generic_jobs(G.heuristic_items(buf, nodes, custom)),
}


#: Sources beyond the built-in detection: name → predicate over the url, tried in order before it.
DETECT: dict[str, Callable[[Column], Column]] = {}


def register_extractor(name: str, extract: Callable, matches: Callable[[Column], Column] | None = None) -> None:
    """O-E1: add a source (or replace one): its extractor (url, buf, nodes, custom) → array of jobs,
    and for a new source the urls that Auto-Detect sends to it."""
    REGISTRY[name] = extract
    if matches is not None:
        DETECT[name] = matches


def detect(url: Column) -> Column:
    """O-C4 with the registered sources in front."""
    out = U.detect_source(url)
    for name, matches in reversed(DETECT.items()):
        out = F.when(matches(url), F.lit(name)).otherwise(out)
    return out


def routed_items(url: Column, buf: Column, nodes: Column, source: Column, custom: dict | None = None) -> Column:
    return _routed_items(url, buf, nodes, source, custom, tuple(REGISTRY.items()))


@cached_column
def _routed_items(url: Column, buf: Column, nodes: Column, source: Column, custom: dict | None, registry: tuple) -> Column:
    out = dict(registry)["Generic"](url, buf, nodes, custom)
    for name, extract in reversed(registry):
        if name != "Generic":
            out = F.when(source == name, extract(url, buf, nodes)).otherwise(out)
    return out


def run_routed(nodes: DataFrame, source: str = "Auto-Detect", max_jobs: int | None = None, custom: dict | None = None) -> DataFrame:
    """Route, extract, label and deduplicate one run.

    ``Auto-Detect`` uses O-C4 per page.  Indeed, LinkedIn and generic rows
    share one seen-set (O-D1 / O-D2 keys); Naukri rows go through the app's
    exact-triple check (O-D3) and are labelled ``Scrapling-Naukri`` (O-X23).
    Both dedups are one window over namespaced keys: a single shuffle.  Jobs of
    Indeed and LinkedIn single-job pages are not deduplicated.  ``max_jobs``
    (O-L2) limits the jobs of a page if the caller sets it; ``custom`` maps
    company, role and description to CSS selectors for generic cards (O-H12).
    """
    src = detect(F.col("url")) if source == "Auto-Detect" else F.lit(source)
    routed = nodes.withColumn("route", src)
    items = routed_items(F.col("url"), F.col("buf"), F.col("nodes"), F.col("route"), custom)
    rejected = (F.col("route") == "Naukri") & (F.col("html_len") < MIN_USABLE_HTML)  # O-C2
    items = F.when(~rejected, items)
    items = items if max_jobs is None else F.slice(items, 1, max_jobs)
    jobs = explode_jobs(routed, items, extra=["route"], single=True)
    key = (
        F.when(F.col("single"), dedup.page_key())
        .when(F.col("route") == "Naukri", F.concat(F.lit("T|"), dedup.triple_key("company", "job_role", "description")))
        .when(F.col("route") == "Generic", F.concat(F.lit("F|"), dedup.description_key("description", "company")))
        .otherwise(F.concat(F.lit("F|"), dedup.role_company_key("job_role", "company")))
    )
    kept = dedup.first_per_key(jobs.withColumn("_k", key), "_k", ["page_id", "pos"]).drop("_k", "single")
    return kept.withColumn("source", F.when(F.col("route") == "Naukri", F.lit("Scrapling-Naukri")).otherwise(F.col("source")))
