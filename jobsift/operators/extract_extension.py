"""Browser-extension rules as Spark Columns (O-C11 … O-C13, O-X16 … O-X22).

The extension reads the live DOM one tab at a time; here every crawled
page is classified and extracted in parallel from its node table.  Texts
follow the DOM definitions: ``textContent`` (all text, trimmed) and
``innerText`` (block boundaries as newlines).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .memo import cached_column

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions import urls as U
from ..functions.text import let
from . import classify as C
from . import select as S
from .jobs import empty_jobs, first_nonempty_text, job


def _tc(buf: Column, n: Column) -> Column:
    """``el.textContent.trim()`` ('' without element)."""
    return F.coalesce(T.js_trim(S.text(buf, n)), F.lit(""))


def find_text(buf: Column, nodes: Column, selectors) -> Column:
    """The extension's ``find``: first selector whose first element has non-empty trimmed text."""
    if S.is_top_pair(buf, nodes):
        parts = [f"nullif(coalesce({T.js_trim_sql(S.text_sql(S.node_sql(s)))}, ''), '')" for s in selectors]
        return F.expr("coalesce(" + ", ".join(parts) + ", '')")
    return first_nonempty_text(*[_tc(buf, S.select_one(nodes, s)) for s in selectors])


def find_all_texts(buf: Column, nodes: Column, selectors) -> Column:
    """``findAll``: trimmed texts of every match, 1–99 chars, distinct, first-seen order."""
    texts = F.flatten(F.array(*[F.transform(S.select_all(nodes, s), lambda e: _tc(buf, e)) for s in selectors]))
    return F.array_distinct(F.filter(texts, lambda t: (F.length(t) > 0) & (F.length(t) < 100)))


NAUKRI_COMPANY = [
    'a[href*="-jobs-careers-"]', 'a[class*="company"]', 'a[class*="comp-name"]', '[class*="company-name"]', '[class*="companyName"]',
    '[class*="org-name"]', '[class*="orgName"]', 'h4[class*="company"]', "[data-company-name]", ".jd-header-title-company", '[class*="subTitle"]',
]
NAUKRI_ROLE = [
    'h1[class*="title"]', 'h1[class*="header"]', "h1.jd-header-title", 'h1[class*="jd-header"]', "h1",
    '[class*="job-title"] h1', ".job-title", '[class*="designation"]',
]
NAUKRI_EXACT_DESC = ['div[class*="JDC__dang-inner-html"]', 'div[class*="dang-inner-html"]']
NAUKRI_CSS_DESC = [
    ".job-details-description", 'div[class*="jd-desc"]', 'div[class*="description"]', 'section[id*="description"]',
    'div[id*="description"]', 'div[class*="job-desc"]', 'div[class*="details-section"]', 'div[class*="job-detail"]',
    'section[class*="description"]', ".styles_jd-header-description", '[class*="detail-section"]', 'div[class*="text-container"]',
    '[class*="jd-section"]', 'div[class*="styles_jd"]',
]
MAIN_AREA = 'main, article, [role="main"], .content, #content, .container'
BOILER = (
    'header, footer, nav, script, style, [class*="header"], [class*="footer"], [class*="navi"], [class*="sidebar"], '
    '[class*="aside"], [class*="banner"], [class*="ad-"], [class*="advertise"], [class*="recommend"]'
)
BODY_BOILER = BOILER + ', [class*="pagination"], [class*="breadcrumb"], [class*="widget"], [class*="chat"], [class*="footer-"]'
NAUKRI_SKILLS = [
    'a[class*="skill"]', 'span[class*="skill"]', ".key-skill a", ".skill-tag", '[class*="skill"] a', ".jd-skills a",
    ".tags-container a", 'a[href*="/skills/"]',
]


def stripped_inner_text_sql(root_css: str, boiler_css: str) -> str:
    """SQL form of :func:`stripped_inner_text` for a page-level root selector."""
    removed = f"filter(slice(nodes, r.pre + 2, r.last - r.pre), n9 -> {S.matches_sql(boiler_css, 'n9')})"
    stitched = (
        f"aggregate({removed}, named_struct('p', r.t0, 'out', ''), "
        "(acc, n8) -> named_struct('p', greatest(acc.p, n8.t1), 'out', concat(acc.out, "
        "CASE WHEN n8.t0 > acc.p THEN substring(buf, acc.p + 1, n8.t0 - acc.p) ELSE '' END)), "
        "acc -> concat(acc.out, substring(buf, acc.p + 1, greatest(r.t1 - acc.p, 0))))"
    )
    text = f"regexp_replace(regexp_replace({stitched}, '[\\\\x00\\\\x01]*\\\\x01[\\\\x00\\\\x01]*', chr(10)), '\\\\x00+', '')"
    return f"get(transform(array({S.node_sql(root_css)}), r -> CASE WHEN r IS NULL THEN '' ELSE {T.js_trim_sql(text)} END), 0)"


def stripped_inner_text(buf: Column, nodes: Column, root: Column, boiler_css: str) -> Column:
    """O-H11: ``innerText`` of a clone of ``root`` with boilerplate subtrees removed.

    Removed subtrees are text intervals ``[t0, t1)`` (pre-order keeps them
    sorted by start); the kept text is the complement, stitched with one
    ``aggregate`` pass.  Runs of boundary markers become one newline.
    """
    removed = F.filter(S.subtree(nodes, root), lambda n: S.matches(boiler_css, n, nodes))
    base = root["t0"]
    init = F.struct(base.alias("p"), F.lit("").alias("out"))

    def step(acc, n):
        seg = F.when(n["t0"] > acc["p"], buf.substr(acc["p"] + 1, n["t0"] - acc["p"])).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["p"], n["t1"]).alias("p"), F.concat(acc["out"], seg).alias("out"))

    stitched = F.aggregate(removed, init, step, lambda acc: F.concat(acc["out"], buf.substr(acc["p"] + 1, F.greatest(root["t1"] - acc["p"], F.lit(0)))))
    text = F.regexp_replace(F.regexp_replace(stitched, "[\\x00\\x01]*\\x01[\\x00\\x01]*", "\n"), "\\x00+", "")
    return F.when(root.isNull(), F.lit("")).otherwise(T.js_trim(text))


@cached_column
def naukri_job_page(url: Column, buf: Column, nodes: Column) -> Column:
    """O-X19: the full Naukri job-page record (with sentinels for a missing company / role)."""
    company = find_text(buf, nodes, NAUKRI_COMPANY)
    role = find_text(buf, nodes, NAUKRI_ROLE)
    exact = first_nonempty_text(*[
        let(T.js_trim(S.inner_text(buf, S.select_one(nodes, s))), lambda t: F.coalesce(F.when(F.length(t) > 30, t), F.lit("")))
        for s in NAUKRI_EXACT_DESC
    ])

    def fallback_desc():
        css = find_text(buf, nodes, NAUKRI_CSS_DESC)
        main = S.select_one(nodes, MAIN_AREA)
        body = S.select_one(nodes, "body")
        if S.is_top_pair(buf, nodes):
            main_text = F.expr(stripped_inner_text_sql(MAIN_AREA, BOILER))
            body_text = F.when(body.isNotNull(), F.expr(stripped_inner_text_sql("body", BODY_BOILER))).otherwise(T.js_trim(S.page_inner_text(buf)))
        else:
            main_text = stripped_inner_text(buf, nodes, main, BOILER)
            body_text = F.when(body.isNotNull(), stripped_inner_text(buf, nodes, body, BODY_BOILER)).otherwise(T.js_trim(S.page_inner_text(buf)))
        fb = let(main_text, lambda mt: F.when(main.isNotNull() & (F.length(mt) >= 100), mt).otherwise(body_text))
        return T.choose_description(css, fb)

    description = let(exact, lambda e: F.when(e != "", e).otherwise(fallback_desc()))
    body_el = S.select_one(nodes, "body")
    body_text = F.substring(F.when(body_el.isNotNull(), T.js_trim(S.inner_text(buf, body_el))).otherwise(T.js_trim(S.page_inner_text(buf))), 1, 20000)
    return let(description, lambda d: job(
        company=T.default_if_empty(company, K.COMPANY_SENTINEL),
        job_role=T.default_if_empty(role, K.ROLE_SENTINEL),
        description=d,
        description_bullets=T.bullets_ext(d),
        highlights=find_text(buf, nodes, ['[class*="highlight"]', '[class*="summary"]', ".job-summary"]),
        skills=find_all_texts(buf, nodes, NAUKRI_SKILLS),
        location=find_text(buf, nodes, ['[class*="location"]', '[class*="loc"]', '[class*="place"]', ".job-location"]),
        experience=find_text(buf, nodes, ['[class*="exp"]', '[class*="experience"]', ".work-exp", ".job-experience"]),
        education=find_text(buf, nodes, ['[class*="education"]', '[class*="edu"]', ".eligibility"]),
        employment_type=T.employment_type(body_text),
        department=T.department(body_text),
        industry=T.industry(body_text),
        source=F.lit("naukri-job-page"),
        link=url,
    ))


@cached_column
def generic_job_page(url: Column, buf: Column, nodes: Column) -> Column:
    """O-X20: company, role, description, location, experience."""
    return job(
        company=find_text(buf, nodes, ['[class*="company"]', '[class*="org"]', 'a[href*="/company/"]']),
        job_role=find_text(buf, nodes, ["h1", 'h1[class*="title"]', '[class*="job-title"] h1']),
        description=find_text(buf, nodes, ["#jobDescriptionText", '[class*="description"]', '[class*="job-detail"]']),
        location=find_text(buf, nodes, ['[class*="location"]', '[class*="loc"]']),
        experience=find_text(buf, nodes, ['[class*="exp"]', '[class*="experience"]']),
        source=F.lit("generic-job-page"),
        link=url,
    )


def accepted(j: Column) -> Column:
    """O-X21: a real company or a real role (non-empty, not a sentinel)."""
    c, r = j["company"], j["job_role"]
    return ((c != "") & ~c.startswith("[COMPANY_")) | ((r != "") & ~r.startswith("[ROLE_"))


# ---------------------------------------------------------------------------
# job links
# ---------------------------------------------------------------------------
LINK_CARD = 'div[class*="cust-job-tuple"], div[class*="sjw__tuple"], div[class*="jobTuple"], div[class*="card"], article, li'
LINK_CARD_COMPANY = 'a[href*="-jobs-careers-"], [class*="company"], [class*="comp-name"], [class*="org"]'
NEAR_COMPANY_RE = "(?:at|with|via)\\s+([A-Z][A-Za-z0-9\\s.&-]{2,40}?)(?:\\s+[A-Z]|$|•|·|\\d)".replace("\\s", T.JWS).replace("$", "\\z")


def resolve(href: Column, page_url: Column) -> Column:
    """``a.href``: absolute URL of an href against the page URL; '' without one."""
    return F.when(T.nz(href) == "", F.lit("")).otherwise(U.resolve(href, page_url))


def _link(url, company, role) -> Column:
    return F.struct(T.nz(url).alias("url"), T.nz(company).alias("company"), T.nz(role).alias("role"))


def _distinct_by_url(links: Column) -> Column:
    """Keep the first link per url (the ``seen`` set), order kept — O(n log n):
    sort by (url, position), keep each url's first entry, sort back by position."""
    tagged = F.filter(
        F.transform(links, lambda l, i: F.struct(T.nz(l["url"]).alias("u"), i.alias("i"), l.alias("l"))),
        lambda x: x["u"] != "",
    )

    def body(srt):
        firsts = F.filter(srt, lambda x, i: (i == 0) | (x["u"] != F.get(srt, i - 1)["u"]))
        back = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["l"].alias("l"))))
        return F.transform(back, lambda x: x["l"])

    return let(F.array_sort(tagged), body)


@cached_column
def naukri_links(url: Column, buf: Column, nodes: Column) -> Column:
    """O-X16: distinct ``/job-listings`` links with the company of their card (or nearby text)."""
    anchors = S.select_all(nodes, 'a[href*="/job-listings"]')
    return let(S.select_all(nodes, LINK_CARD), lambda cards_all: _naukri_links(url, buf, nodes, anchors, cards_all))


def _naukri_links(url, buf, nodes, anchors, cards_all):
    def per_anchor(a):
        href = resolve(S.attr(a, "href"), url)
        # closest(): among the card-like elements containing the anchor, the one with the largest pre
        card = let(F.filter(cards_all, lambda c: (c["pre"] <= a["pre"]) & (a["pre"] <= c["last"])),
                   lambda anc: F.get(anc, F.size(anc) - 1))
        card_company = F.when(card.isNotNull(), _tc(buf, S.select_one(nodes, LINK_CARD_COMPANY, scope=card))).otherwise(F.lit(""))
        near = _near_company(buf, nodes, a)
        company = let(card_company, lambda c: F.when(c != "", c).otherwise(near))
        return _link(U.absolutize(href, url), company, _tc(buf, a))

    primary = _distinct_by_url(F.transform(anchors, per_anchor))
    cards = S.select_all(nodes, 'div[class*="cust-job-tuple"], div[class*="sjw__tuple"], div[class*="jobTuple"], section[class*="job"], article[class*="job"]')

    def per_card(c):
        a = S.select_one(nodes, 'a[href*="/job-listings"], a[href*="-job-"], a[class*="title"]', scope=c)
        href = resolve(S.attr(a, "href"), url)
        comp = _tc(buf, S.select_one(nodes, 'a[href*="-jobs-careers-"], [class*="company"], [class*="comp-name"]', scope=c))
        return F.when(a.isNotNull(), _link(href, comp, _tc(buf, a)))

    secondary = _distinct_by_url(F.filter(F.transform(cards, per_card), lambda x: x.isNotNull()))
    return let(primary, lambda p: F.when(F.size(p) > 0, p).otherwise(secondary))


def _near_company(buf: Column, nodes: Column, a: Column) -> Column:
    """Regex "(at|with|via) X" on the text of up to five ancestors, nearest first."""
    out = F.lit("")
    p = a
    parents = []
    for _ in range(5):
        p = F.get(nodes, p["parent"])
        parents.append(p)
    for anc in reversed(parents):
        hit = let(S.text(buf, anc), lambda t: F.when(t.rlike(NEAR_COMPANY_RE), T.js_trim(F.regexp_extract(t, NEAR_COMPANY_RE, 1))))
        out = F.coalesce(hit, out)
    return out


GENERIC_LINK_CARDS = 'article, div[class*="card"], div[class*="result"], li[class*="job"]'
GENERIC_LINK_ANCHOR = 'a[href*="/job"], a[href*="/career"], a[href*="/position"]'


@cached_column
def generic_links(url: Column, buf: Column, nodes: Column) -> Column:
    """O-X17: one link per card; else every job-like link with text of 3–199 chars."""
    cards = S.select_all(nodes, GENERIC_LINK_CARDS)

    def per_card(c):
        a = S.select_one(nodes, GENERIC_LINK_ANCHOR, scope=c)
        comp = F.coalesce(S.text(buf, S.select_one(nodes, '[class*="company"], [class*="org"], [class*="employer"]', scope=c)), F.lit(""))
        return F.when(a.isNotNull(), _link(resolve(S.attr(a, "href"), url), T.js_trim(comp), _tc(buf, a)))

    primary = _distinct_by_url(F.filter(F.transform(cards, per_card), lambda x: x.isNotNull()))
    anchors = S.select_all(nodes, C.GENERIC_JOB_LINKS)
    everything = _distinct_by_url(F.transform(anchors, lambda a: _link(resolve(S.attr(a, "href"), url), F.lit(""), _tc(buf, a))))
    fallback = F.filter(everything, lambda x: (F.length(x["role"]) > 2) & (F.length(x["role"]) < 200))
    return let(primary, lambda p: F.when(F.size(p) > 0, p).otherwise(fallback))


@cached_column
def script_links(buf: Column, nodes: Column) -> Column:
    """O-X18: cards need ≥ 2 hits; first unseen ``/job-listings`` link per card; company[:80], title[:120]."""
    sels = ['div[class*="jobTuple"]', ".job-tuple", "article", 'div[class*="card"]']

    def at_least_two(nxt):
        return lambda a: F.when(F.size(a) >= 2, a).otherwise(nxt)

    cards = F.array().cast(S.nodes_type_hint(nodes))
    for s_ in reversed(sels):
        cards = let(S.select_all(nodes, s_), at_least_two(cards))

    def per_card_links(c):
        anchors = S.select_all(nodes, 'a[href*="/job-listings"]', scope=c)
        comp = T.py_strip(F.coalesce(S.text(buf, S.select_one(nodes, '[class*="company"], [class*="org"]', scope=c)), F.lit("")))
        return F.transform(anchors, lambda a: F.struct(
            T.nz(S.attr(a, "href")).alias("href"), F.substring(comp, 1, 80).alias("company"),
            F.substring(T.py_strip(F.coalesce(S.text(buf, a), F.lit(""))), 1, 120).alias("role"),
        ))

    # one link per card: the first whose href was not taken by an earlier card
    empty = F.filter(F.array(F.struct(F.lit("").alias("href"), F.lit("").alias("company"), F.lit("").alias("role"))), lambda x: F.lit(False))

    def step(acc, c):
        fresh = F.filter(per_card_links(c), lambda l: ~F.exists(acc, lambda p: p["href"] == l["href"]))
        return F.when(F.size(fresh) > 0, F.concat(acc, F.slice(fresh, 1, 1))).otherwise(acc)

    picked = F.aggregate(cards, empty, step)
    return F.transform(picked, lambda x: _link(
        F.when(x["href"].startswith("http"), x["href"]).otherwise(F.concat(F.lit(K.NAUKRI_BASE_URL), x["href"])), x["company"], x["role"]))


@cached_column
def script_job_page(buf: Column, nodes: Column) -> Column:
    """O-X22: company[:100], role[:120], description length, first 15 skills; '[MISSING]' defaults."""
    def first_el(sels, n):
        vals = [F.substring(T.py_strip(S.text(buf, S.select_one(nodes, s))), 1, n) for s in sels]  # NULL without a match
        return F.coalesce(*vals, F.lit(""))

    company = first_el([".jd-header-title-company", 'a[class*="company"]', '[class*="company-name"]'], 100)
    role = first_el([".jd-header-title", 'h1[class*="title"]', "h1"], 120)
    desc = first_el([".job-details-description", ".jd-desc", 'div[class*="description"]'], 1 << 30)
    skill_lists = [F.transform(F.slice(S.select_all(nodes, s), 1, 15), lambda e: T.py_strip(S.text(buf, e))) for s in [".key-skill", ".skill", '[class*="skill"]']]
    skills = F.lit(None).cast("array<string>")
    for sl in reversed(skill_lists):
        skills = let(sl, (lambda nxt: lambda a: F.when(F.size(a) > 0, a).otherwise(nxt))(skills))
    return F.struct(
        T.default_if_empty(company, "[MISSING]").alias("company"), T.default_if_empty(role, "[MISSING]").alias("role"),
        F.length(desc).alias("desc_len"), F.coalesce(skills, F.array().cast("array<string>")).alias("skills"),
    )


@dataclass(frozen=True)
class SiteRules:
    """O-E2: what the content script knows of a site; Column functions of (url, buf, nodes).

    ``host`` is a part of the host name; the rules without one hold for all other hosts.
    """

    is_listing: Callable[[Column, Column, Column], Column]
    is_job: Callable[[Column, Column, Column], Column]
    links: Callable[[Column, Column, Column], Column]
    job_page: Callable[[Column, Column, Column], Column]
    host: str | None = None


SITES: dict[str, SiteRules] = {
    "naukri": SiteRules(
        lambda url, buf, nodes: C.naukri_is_listing(nodes, url), lambda url, buf, nodes: C.naukri_is_job(nodes, url), naukri_links, naukri_job_page, "naukri.com",
    ),
    "generic": SiteRules(
        lambda url, buf, nodes: C.generic_is_listing(nodes), lambda url, buf, nodes: C.generic_is_job(nodes), generic_links, generic_job_page,
    ),
}


def register_site(name: str, rules: SiteRules) -> None:
    """Add a site, or replace its rules; of several hosts that match, the site registered first wins."""
    if (rules.host is None) != (name == "generic"):
        raise ValueError("only the generic rules have no host")
    SITES[name] = rules


def scrape_page(url: Column, buf: Column, nodes: Column, with_links: bool = True) -> Column:
    """The content script on one page: page type, accepted job data, job links (O-C13), by the rules of its site.

    ``with_links=False`` leaves link extraction out of the expression (for
    runs that only keep job data); a listing page then reports ``listing``.
    """
    return _scrape_page(url, buf, nodes, with_links, tuple(SITES.values()))


@cached_column
def _scrape_page(url: Column, buf: Column, nodes: Column, with_links: bool, sites: tuple[SiteRules, ...]) -> Column:
    def of_site(rule: str) -> Column:
        out = getattr(next(s for s in sites if s.host is None), rule)(url, buf, nodes)
        for s in reversed([s for s in sites if s.host is not None]):
            out = F.when(U.host_contains(url, s.host), getattr(s, rule)(url, buf, nodes)).otherwise(out)
        return out

    none = F.filter(F.array(_link(F.lit(""), F.lit(""), F.lit(""))), lambda x: F.lit(False))
    data = of_site("job_page")
    no_data = empty_jobs()  # not made from ``data``: that would extract the record of every page that is no job
    return (
        F.when(of_site("is_job"), let(data, lambda d: F.struct(
            F.lit("job").alias("page_type"), F.when(accepted(d), F.array(d)).otherwise(F.filter(F.array(d), lambda x: F.lit(False))).alias("data"),
            none.alias("links"))))
        .when(of_site("is_listing"), let(of_site("links") if with_links else none, lambda ls: F.struct(
            F.when(F.size(ls) > 0, F.lit("listing-with-links")).otherwise(F.lit("listing")).alias("page_type"),
            no_data.alias("data"), ls.alias("links"))))
        .otherwise(F.struct(F.lit("unknown").alias("page_type"), no_data.alias("data"), none.alias("links")))
    )
