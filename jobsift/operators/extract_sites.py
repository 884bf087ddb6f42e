"""Site extractors: Indeed (O-X7, O-X8), LinkedIn (O-X9, O-X10), Naukri (O-X12 … O-X15).

Each ``*_jobs(url, buf, nodes)`` returns the page's job array; the cards /
single-page fallback (O-X11) is a lazy ``CASE`` so the single-page cascades
only run for pages without cards.
"""

from __future__ import annotations

from .memo import cached_column

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions import urls as U
from ..functions.text import let
from . import select as S
from .jobs import empty_jobs, first_nonempty, first_nonempty_text, job


def _exact(v: str) -> str:
    return "^" + re.escape(v) + "$"


def _first(*nodes: Column) -> Column:
    return F.coalesce(*nodes)


def _txt(buf: Column, n: Column) -> Column:
    """clean(get_text()) or NULL when there is no element."""
    return F.when(n.isNotNull(), T.clean_text(S.text(buf, n)))


def _cascade_text(buf, nodes, selectors, sep: str | None = None) -> Column:
    """O-H6: first selector whose first element has non-blank text → cleaned text."""
    if S.is_top_pair(buf, nodes):
        mode = "text" if sep is None else "sep"
        parts = [f"nullif({T.clean_sql(S.text_sql(S.node_sql(s), mode, sep or ''))}, '')" for s in selectors]
        return F.expr("coalesce(" + ", ".join(parts) + ", '')")
    outs = []
    for sel in selectors:
        el = S.select_one(nodes, sel)
        raw = S.text(buf, el) if sep is None else S.text_sep(buf, el, sep)
        outs.append(T.clean_text(raw))
    return first_nonempty_text(*outs)


# ---------------------------------------------------------------------------
# Indeed
# ---------------------------------------------------------------------------
def indeed_cards(nodes: Column) -> Column:
    return first_nonempty(
        S.find_all(nodes, "div", cls_re="job_seen_beacon|cardOutline|jobCard"),
        S.find_all(nodes, "div", attrs={"data-testid": "job-card|slider"}),
        S.find_all(nodes, "li", cls_re="jobListing|result"),
    )


def indeed_card(buf: Column, nodes: Column, c: Column) -> Column:
    title_el = _first(
        S.find(nodes, "h2", cls_re="jobTitle|title", scope=c),
        S.find(nodes, "a", attrs={"data-tn-element": _exact("jobTitle")}, scope=c),
        S.select_one(nodes, "a[id*='job_']", scope=c),
    )
    company_el = _first(
        S.find(nodes, "span", attrs={"data-testid": _exact("company-name")}, scope=c),
        S.find(nodes, "span", cls_re="companyName|company", scope=c),
        S.find(nodes, "div", cls_re="heading6|company_location", scope=c),
    )
    loc_el = _first(
        S.find(nodes, "div", attrs={"data-testid": _exact("text-location")}, scope=c),
        S.find(nodes, "div", cls_re="companyLocation|location", scope=c),
    )
    link_el = S.find(nodes, "a", attrs={"href": "/company/|/pagead/|/rc/|/viewjob"}, scope=c)
    loc = _txt(buf, loc_el)

    def build(t_el):
        span = S.find(nodes, "span", scope=t_el)
        return let(F.when(t_el.isNotNull(), T.clean_text(S.text(buf, F.coalesce(span, t_el)))), lambda title: build2(title))

    def build2(title):
        return let(_txt(buf, company_el), lambda company: F.when(
            (T.nz(title) != "") | (T.nz(company) != ""),
            job(
                company=F.coalesce(company, F.lit(K.INDEED_CARD_COMPANY)),
                job_role=F.coalesce(title, F.lit(K.DEFAULT_ROLE_ENGINEER)),
                description=F.concat(F.lit("Job posting for "), F.coalesce(title, F.lit("role")), F.lit(" at "), F.coalesce(company, F.lit("company")), F.lit(".")),
                description_bullets=F.array(F.concat(F.lit("Location: "), F.coalesce(loc, F.lit("N/A")))),
                location=loc,
                source=F.lit("Indeed"),
                link=F.when(link_el.isNotNull(), U.urljoin_base(S.attr(link_el, "href"), K.INDEED_BASE_URL)),
            ),
        ))

    return let(title_el, build)


def indeed_single(buf: Column, nodes: Column) -> Column:
    title = _cascade_text(buf, nodes, ["h1.jobsearch-JobInfoHeader-title", "h1[class*='JobInfoHeader']", "h1"])
    company = _cascade_text(buf, nodes, ["div[data-testid='inlineHeader-companyName']", "span.jobsearch-CompanyReview--heading", "[data-company-name]"])
    desc_el = _first(S.select_one(nodes, "#jobDescriptionText"), S.select_one(nodes, "div.jobsearch-JobComponent-description"))
    desc = T.clean_text(S.text_sep(buf, desc_el, "\n"))
    return _single(title, company, desc, K.INDEED_SINGLE_COMPANY, K.DEFAULT_ROLE_ENGINEER, K.INDEED_SINGLE_DESCRIPTION, "Indeed")


def _single(title, company, desc, d_company, d_role, d_desc, source) -> Column:
    def body(v):
        t, c, d = v["t"], v["c"], v["d"]
        row = job(
            company=T.default_if_empty(c, d_company),
            job_role=T.default_if_empty(t, d_role),
            description=T.default_if_empty(d, d_desc),
            description_bullets=T.bullets_or_description(T.bullets_base(d), d),
            source=F.lit(source),
            single=True,
        )
        return F.when((t != "") | (c != "") | (d != ""), F.array(row)).otherwise(empty_jobs())

    return let(F.struct(title.alias("t"), company.alias("c"), desc.alias("d")), body)


@cached_column
def indeed_jobs(url: Column, buf: Column, nodes: Column) -> Column:
    """O-X11: single-job URL or no cards → single page; else one row per card."""
    return F.when(U.is_single_job_url(url, "Indeed"), indeed_single(buf, nodes)).otherwise(
        let(indeed_cards(nodes), lambda cs: F.when(F.size(cs) == 0, indeed_single(buf, nodes)).otherwise(
            F.filter(F.transform(cs, lambda c: indeed_card(buf, nodes, c)), lambda j: j.isNotNull())))
    )


def indeed_is_single(url: Column, nodes: Column) -> Column:
    return U.is_single_job_url(url, "Indeed") | (F.size(indeed_cards(nodes)) == 0)


def indeed_found(url: Column, buf: Column, nodes: Column) -> Column:
    """total_found: number of cards; on the single-page path 1 if anything was parsed, else 0."""
    return F.when(indeed_is_single(url, nodes), F.size(indeed_single(buf, nodes))).otherwise(F.size(indeed_cards(nodes)))


# ---------------------------------------------------------------------------
# LinkedIn
# ---------------------------------------------------------------------------
LINKEDIN_CARDS = [
    "li.jobs-search__results-list > li", "div.base-card", "div.base-search-card", "li[class*='job-card']",
    "div[class*='job-search-card']", "article[class*='job']", "[data-job-id]",
]
LINKEDIN_TITLE = ["h3.base-search-card__title", "h3[class*='job-card']", "a[class*='job-card'] span", "[class*='job-title']", "h3", "a.job-card-list__title"]
LINKEDIN_COMPANY = ["h4.base-search-card__subtitle", "a[class*='company']", "[class*='company-name']", "[class*='org-name']", "h4", "span.job-card-container__primary-description"]
LINKEDIN_LOCATION = ["[class*='job-location']", "[class*='location']", "span[class*='metadata']", "li.job-card-container__metadata-item"]


def linkedin_cards(nodes: Column) -> Column:
    return first_nonempty(*[S.select_all(nodes, s) for s in LINKEDIN_CARDS])


def linkedin_card(buf: Column, nodes: Column, c: Column) -> Column:
    """LinkedIn cards take the first *element* of each cascade, blank or not."""
    title_el = _first(*[S.select_one(nodes, s, scope=c) for s in LINKEDIN_TITLE])
    company_el = _first(*[S.select_one(nodes, s, scope=c) for s in LINKEDIN_COMPANY])
    loc_el = _first(*[S.select_one(nodes, s, scope=c) for s in LINKEDIN_LOCATION])
    link_el = _first(S.select_one(nodes, "a[href*='/jobs/view']", scope=c), S.find(nodes, "a", attrs={"href": "/jobs/view"}, scope=c))
    loc = _txt(buf, loc_el)

    def build(title):
        return let(_txt(buf, company_el), lambda company: F.when(
            (T.nz(title) != "") | (T.nz(company) != ""),
            job(
                company=F.coalesce(company, F.lit(K.LINKEDIN_CARD_COMPANY)),
                job_role=F.coalesce(title, F.lit(K.DEFAULT_ROLE_ENGINEER)),
                description=F.concat(F.lit("Job posting position for "), F.coalesce(title, F.lit("role")), F.lit(" at "), F.coalesce(company, F.lit("company")), F.lit(".")),
                description_bullets=F.array(F.concat(F.lit("Location: "), F.coalesce(loc, F.lit("N/A")))),
                location=loc,
                source=F.lit("LinkedIn"),
                link=F.when(link_el.isNotNull(), U.strip_query(S.attr(link_el, "href"))),
            ),
        ))

    return let(_txt(buf, title_el), build)


def linkedin_single(buf: Column, nodes: Column) -> Column:
    title = _cascade_text(buf, nodes, ["h1.top-card-layout__title", "h1.job-details-jobs-unified-top-card__job-title", "h1[class*='title']", "h1"])
    company = _cascade_text(buf, nodes, [
        "a.topcard__org-name-link", "div.job-details-jobs-unified-top-card__company-name", "a[href*='/company/']",
        "span.topcard__flavor", "[class*='company-name']",
    ])
    desc = _cascade_text(buf, nodes, [
        "div.show-more-less-html__markup", "div.description__text", "div.jobs-description-content",
        "article[class*='description']", "section[class*='description']",
    ], sep="\n")
    return _single(title, company, desc, K.LINKEDIN_SINGLE_COMPANY, K.DEFAULT_ROLE_ENGINEER, K.LINKEDIN_SINGLE_DESCRIPTION, "LinkedIn")


@cached_column
def linkedin_jobs(url: Column, buf: Column, nodes: Column) -> Column:
    return F.when(U.is_single_job_url(url, "LinkedIn"), linkedin_single(buf, nodes)).otherwise(
        let(linkedin_cards(nodes), lambda cs: F.when(F.size(cs) == 0, linkedin_single(buf, nodes)).otherwise(
            F.filter(F.transform(cs, lambda c: linkedin_card(buf, nodes, c)), lambda j: j.isNotNull())))
    )


def linkedin_is_single(url: Column, nodes: Column) -> Column:
    return U.is_single_job_url(url, "LinkedIn") | (F.size(linkedin_cards(nodes)) == 0)


def linkedin_found(url: Column, buf: Column, nodes: Column) -> Column:
    return F.when(linkedin_is_single(url, nodes), F.size(linkedin_single(buf, nodes))).otherwise(F.size(linkedin_cards(nodes)))


# ---------------------------------------------------------------------------
# Naukri listing engine
# ---------------------------------------------------------------------------
NAUKRI_CARDS = 'div.cust-job-tuple, div[class*="cust-job-tuple"], div.sjw__tuple, article[class*="job"], div[class*="jobTuple"], div.srp-jobtuple-wrapper'
NAUKRI_SKILL_SELECTORS = [".key-skill", ".skill", "[class*='chip']", "[class*='key-skill']"]


def naukri_cards(nodes: Column) -> Column:
    return first_nonempty(S.select_all(nodes, NAUKRI_CARDS), S.find_all(nodes, "div", attrs={"data-job-id": True}))


def stripped_text(buf: Column, n: Column, sep: str = " ") -> Column:
    """``get_text(separator=sep, strip=True)``: each text node stripped, blanks dropped."""
    parts = F.split(S.raw_text(buf, n), "[\\x00\\x01]", -1)
    return F.array_join(F.filter(F.transform(parts, T.py_strip), lambda s: s != ""), sep)


def naukri_card(buf: Column, nodes: Column, c: Column) -> Column:
    title_el = S.select_one(nodes, 'a[href*="job-listings"], a[class*="title"], a.title', scope=c)
    company_el = S.select_one(nodes, 'a[href*="-jobs-careers-"], a[class*="company"], .comp-name', scope=c)
    skill_els = S.select_all(nodes, '[class*="skill"], [class*="key"], a[class*="skill"], span[class*="tag"]', scope=c)
    skills = F.filter(F.transform(skill_els, lambda e: T.clean_text(S.text(buf, e))), lambda s: s != "")

    def build(all_text):
        desc = T.clean_text(F.substring(all_text, 1, 280))
        return job(
            company=T.default_if_empty(T.nz(_txt(buf, company_el)), K.NAUKRI_CARD_COMPANY),
            job_role=T.default_if_empty(T.nz(_txt(buf, title_el)), K.NAUKRI_CARD_ROLE),
            description=desc,
            description_bullets=T.bullets_engine(desc),
            skills=F.slice(skills, 1, 10),
            location=T.location_lookup(all_text),
            experience=T.experience(all_text),
            source=F.lit("Naukri"),
        )

    return let(F.regexp_replace(stripped_text(buf, c, " "), f"{T.WS}+", " "), build)


def naukri_single(buf: Column, nodes: Column) -> Column:
    """O-X13: page-level cascades; none of title/company/description → no row."""
    title = _cascade_text(buf, nodes, [".jd-header-title", "h1[class*='title']", "h1.styles_j24-wrapper__title", "h1"])
    company = _cascade_text(buf, nodes, [".jd-header-title-company", "a[class*='company']", "[class*='comp-name']", "a[href*='careers']"])
    desc = _cascade_text(buf, nodes, [
        ".job-details-description", ".jd-desc", "div[class*='styles_j24-wrapper__description']",
        "section[class*='description']", "div[class*='job-desc']",
    ], sep="\n")
    skill_lists = [
        F.filter(F.transform(S.select_all(nodes, s), lambda e: T.clean_text(S.text(buf, e))), lambda x: x != "")
        for s in NAUKRI_SKILL_SELECTORS
    ]
    def body(v):
        t, c, d = v["t"], v["c"], v["d"]
        row = job(
            company=T.default_if_empty(c, K.NAUKRI_SINGLE_COMPANY),
            job_role=T.default_if_empty(t, K.NAUKRI_SINGLE_ROLE),
            description=T.default_if_empty(d, K.NAUKRI_SINGLE_DESCRIPTION),
            description_bullets=T.bullets_or_description(T.bullets_engine(d), d),
            skills=first_nonempty(*skill_lists),
            location=F.lit(K.NAUKRI_SINGLE_LOCATION),
            experience=F.lit(K.NAUKRI_SINGLE_EXPERIENCE),
            source=F.lit("Naukri"),
        )
        return F.when((t != "") | (c != "") | (d != ""), F.array(row)).otherwise(empty_jobs())

    return let(F.struct(title.alias("t"), company.alias("c"), desc.alias("d")), body)


@cached_column
def naukri_jobs(buf: Column, nodes: Column, prefer: str = "single", max_jobs: int | None = None) -> Column:
    """O-X14: single page first (the reference rule) or cards first; at most ``max_jobs`` if the caller sets it (O-L2)."""
    cards = F.transform(naukri_cards(nodes), lambda c: naukri_card(buf, nodes, c))
    if prefer == "single":
        out = let(naukri_single(buf, nodes), lambda s: F.when(F.size(s) > 0, s).otherwise(cards))
    elif prefer == "cards":
        out = let(cards, lambda cs: F.when(F.size(cs) > 0, cs).otherwise(naukri_single(buf, nodes)))
    else:
        raise ValueError("prefer must be 'single' or 'cards'")
    return out if max_jobs is None else F.slice(out, 1, max_jobs)
