"""Crawled-page fixtures derived inside Spark from ``part``, ``supplier``, ``nation``.

The supplied ``pages`` hold no job cards, tables or JSON-LD, so the site
extractors are exercised on listing pages that Spark *writes* from the
TPC-H-style tables: one listing page per supplier whose cards are the parts
it supplies (part ``p`` → supplier ``min_key + p mod S``, every part used),
company = ``s_name``, role = ``p_name``, location from ``n_name``.  The
pages grow with the tables; the expected extraction is a plain SQL join of
the same tables (see :mod:`jobsift.plans.oracle`).

Per-supplier grouping is bounded by the parts-per-supplier ratio of the
generator (P/S = 20), so ``collect_list`` per page is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import read_table
from .pages import dealt


def esc(c) -> Column:
    """HTML text/attribute escaping."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, s_suppkey, company, role, p_type, p_brand, p_size, nation, region)."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n_supp = supp.select(F.count("*")).scalar()
    min_key = supp.select(F.min("s_suppkey")).scalar()
    keyed = part.select("*", (min_key + F.col("p_partkey") % n_supp).alias("s_suppkey"))
    j = keyed.join(supp, "s_suppkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select(
        F.col("p_partkey").alias("job_id"), "s_suppkey", F.col("s_name").alias("company"), F.col("p_name").alias("role"),
        "p_type", "p_brand", "p_size", F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"),
    )


def place(region: Column) -> Column:
    """A place name per region (position ``region + 1`` of the fixed place list)."""
    return F.element_at(F.array(*[F.lit(p) for p in K.PLACES]), region + 1)


def description(j=None) -> Column:
    """A short multi-part job description built from part attributes."""
    return F.concat(
        F.lit("Build "), F.lower(F.col("p_type")), F.lit(" products for the "), F.col("p_brand"), F.lit(" line. "),
        F.lit("- Own size "), F.col("p_size").cast("string"), F.lit(" assemblies end to end"),
        F.lit(" - Work with the "), F.col("nation"), F.lit(" team every week"),
    )


def experience_text() -> Column:
    return F.concat((F.col("p_size") / 10).cast("int").cast("string"), F.lit("-"), ((F.col("p_size") / 10).cast("int") + 3).cast("string"), F.lit(" Yrs"))


def no_company() -> Column:
    """Data-driven variant: cards of ``SMALL`` parts leave the company out."""
    return F.col("p_type") == "SMALL"


def _pages(jobs: DataFrame, card: Column, url: Column, head: str = "", tail: str = "", wrap=("<div class=\"results\">", "</div>")) -> DataFrame:
    cards = dealt(jobs, "s_suppkey").select("s_suppkey", "job_id", card.alias("card"), url.alias("url"))
    grouped = cards.groupBy("s_suppkey").agg(
        F.first("url").alias("url"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("job_id", "card"))), lambda x: x["card"]), "").alias("body"),
    )
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Jobs</title></head><body>" + head + wrap[0]), F.col("body"),
        F.lit(wrap[1] + tail + "</body></html>"),
    )
    return grouped.select(F.col("s_suppkey").cast("bigint").alias("page_id"), "url", html.alias("html"))


def indeed_pages(spark, sf_dir) -> DataFrame:
    j = job_rows(spark, sf_dir)
    k = F.col("job_id").cast("string")
    company = F.when(no_company(), F.lit("")).otherwise(F.concat(F.lit('<span data-testid="company-name">'), esc("company"), F.lit("</span>")))
    loc = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit('<div class="companyLocation">'), esc("nation"), F.lit("</div>"))).otherwise(
        F.concat(F.lit('<div data-testid="text-location">'), esc("nation"), F.lit("</div>"))
    )
    card = F.concat(
        F.lit('<div class="job_seen_beacon cardOutline"><h2 class="jobTitle"><a id="job_'), k, F.lit('" href="/rc/clk?jk='), k,
        F.lit('"><span title="t">'), esc("role"), F.lit("</span></a></h2>"), company, loc, F.lit("</div>"),
    )
    url = F.concat(F.lit("https://www.indeed.com/jobs?q=supplier&l="), F.col("s_suppkey").cast("string"))
    return _pages(j, card, url)


def linkedin_pages(spark, sf_dir) -> DataFrame:
    j = job_rows(spark, sf_dir)
    k = F.col("job_id").cast("string")
    company = F.when(no_company(), F.lit("")).otherwise(F.concat(F.lit('<h4 class="base-search-card__subtitle">'), esc("company"), F.lit("</h4>")))
    card = F.concat(
        F.lit('<div class="base-card"><h3 class="base-search-card__title">'), esc("role"), F.lit("</h3>"), company,
        F.lit('<a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/'), k, F.lit('?refId=abc&amp;trk=x">View</a>'),
        F.lit('<span class="job-search-card__location">'), esc("nation"), F.lit("</span></div>"),
    )
    url = F.concat(F.lit("https://www.linkedin.com/jobs/search?keywords=supplier&f="), F.col("s_suppkey").cast("string"))
    return _pages(j, card, url)


def naukri_pages(spark, sf_dir) -> DataFrame:
    j = job_rows(spark, sf_dir)
    k = F.col("job_id").cast("string")
    company = F.when(no_company(), F.lit("")).otherwise(
        F.concat(F.lit('<a class="comp-name" href="/c-jobs-careers-'), F.col("s_suppkey").cast("string"), F.lit('">'), esc("company"), F.lit("</a>"))
    )
    card = F.concat(
        F.lit('<div class="srp-jobtuple-wrapper"><div class="cust-job-tuple jobTuple"><a class="title" href="/job-listings-r-'), k, F.lit('">'),
        esc("role"), F.lit("</a>"), company,
        F.lit('<span class="exp-wrap"> '), experience_text(), F.lit(' </span><span class="loc-wrap">'), esc("nation"), F.lit(", "),
        esc(place(F.col("region"))), F.lit('</span><div class="key-skills"><span class="skill">'), esc("p_brand"),
        F.lit('</span><span class="tag">'), F.lower(F.col("p_type")), F.lit("</span></div></div></div>"),
    )
    url = F.concat(F.lit("https://www.naukri.com/supplier-"), F.col("s_suppkey").cast("string"), F.lit("-jobs"))
    return _pages(j, card, url)


def generic_card_pages(spark, sf_dir) -> DataFrame:
    j = job_rows(spark, sf_dir)
    company = F.when(no_company(), F.lit("")).otherwise(F.concat(F.lit('<h3 class="company-name">'), esc("company"), F.lit("</h3>")))
    card = F.concat(
        F.lit('<div class="company-card">'), company, F.lit('<span class="job-title">'), esc("role"), F.lit("</span>"),
        F.lit('<p class="description">'), esc(description()), F.lit("</p></div>"),
    )
    url = F.concat(F.lit("https://careers.example.com/suppliers/"), F.col("s_suppkey").cast("string"))
    return _pages(j, card, url)


def table_pages(spark, sf_dir) -> DataFrame:
    j = job_rows(spark, sf_dir)
    row = F.concat(
        F.lit("<tr><td>"), esc("company"), F.lit("</td><td>"), esc("role"), F.lit("</td><td>"), esc(description()), F.lit("</td></tr>")
    )
    url = F.concat(F.lit("https://directory.example.com/table/"), F.col("s_suppkey").cast("string"))
    wrap = ("<table><thead><tr><th>Company Name</th><th>Job Title</th><th>Description</th></tr></thead><tbody>", "</tbody></table>")
    return _pages(j, row, url, wrap=wrap)


def jsonld_pages(spark, sf_dir) -> DataFrame:
    """One JSON-LD ``JobPosting`` script per job; ``SMALL`` parts name the organisation as a plain string."""
    j = job_rows(spark, sf_dir)

    def posting(org: Column) -> Column:
        return F.to_json(F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("JobPosting").alias("@type"), F.col("role").alias("title"),
            org.alias("hiringOrganization"), description().alias("description"),
        ))

    doc = F.when(no_company(), posting(F.col("company"))).otherwise(
        posting(F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name")))
    )
    card = F.concat(F.lit('<script type="application/ld+json">'), doc, F.lit("</script>"))
    url = F.concat(F.lit("https://jobs.example.org/posting/"), F.col("s_suppkey").cast("string"))
    return _pages(j, card, url, wrap=("<main>", "</main>"))


def text_pattern_pages(spark, sf_dir) -> DataFrame:
    j = job_rows(spark, sf_dir)
    company = F.replace(F.col("company"), F.lit("#"), F.lit(" "))
    card = F.concat(F.lit("<p>Join "), esc(company), F.lit(" as a "), esc("role"), F.lit(". </p>"))
    url = F.concat(F.lit("https://news.example.net/hiring/"), F.col("s_suppkey").cast("string"))
    return _pages(j, card, url, wrap=("<article>", "</article>"))


def _jsonld_card() -> Column:
    def posting(org: Column) -> Column:
        return F.to_json(F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("JobPosting").alias("@type"), F.col("role").alias("title"),
            org.alias("hiringOrganization"), description().alias("description"),
        ))

    doc = F.when(no_company(), posting(F.col("company"))).otherwise(
        posting(F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name")))
    )
    return F.concat(F.lit('<script type="application/ld+json">'), doc, F.lit("</script>"))


def _table_card() -> Column:
    return F.concat(
        F.lit("<table><thead><tr><th>Company Name</th><th>Job Title</th><th>Description</th></tr></thead><tbody><tr><td>"),
        esc("company"), F.lit("</td><td>"), esc("role"), F.lit("</td><td>"), esc(description()), F.lit("</td></tr></tbody></table>"),
    )


def _generic_card() -> Column:
    company = F.when(no_company(), F.lit("")).otherwise(F.concat(F.lit('<h3 class="company-name">'), esc("company"), F.lit("</h3>")))
    return F.concat(
        F.lit('<div class="company-card">'), company, F.lit('<span class="job-title">'), esc("role"), F.lit("</span>"),
        F.lit('<p class="description">'), esc(description()), F.lit("</p></div>"),
    )


CUSTOM_SELECTORS = {"company": "em.cc", "role": "em.cr", "description": "em.cd"}


def custom_card_pages(spark, sf_dir) -> DataFrame:
    """Generic cards whose elements for custom selectors are complete, partly there or missing, by ``p_size``."""
    em = lambda cls, value: F.concat(F.lit(f'<em class="{cls}">Custom '), value, F.lit("</em>"))
    inside = F.concat(
        F.when(F.col("p_size") % 3 != 0, em("cc", esc("company"))).otherwise(F.lit("")),
        F.when(F.col("p_size") % 2 == 0, em("cr", esc("role"))).otherwise(F.lit("")), em("cd", esc("p_brand")),
    )
    card = F.concat(F.substring_index(_generic_card(), "</div>", 1), inside, F.lit("</div>"))
    url = F.concat(F.lit("https://www.example-jobs.com/custom/"), F.col("s_suppkey").cast("string"))
    return _pages(job_rows(spark, sf_dir), card, url, wrap=("<section>", "</section>"))


def _text_card() -> Column:
    return F.concat(F.lit("<p>Join "), esc(F.replace(F.col("company"), F.lit("#"), F.lit(" "))), F.lit(" as a "), esc("role"), F.lit(". </p>"))


def mixed_pages(spark, sf_dir) -> DataFrame:
    """Pages whose layout depends on the supplier's region: 0 JSON-LD, 1 tables,
    2 cards, 3 text, 4 JSON-LD + tables + cards (JSON-LD must win)."""
    j = job_rows(spark, sf_dir)
    card = (
        F.when(F.col("region") == 0, _jsonld_card())
        .when(F.col("region") == 1, _table_card())
        .when(F.col("region") == 2, _generic_card())
        .when(F.col("region") == 3, _text_card())
        .otherwise(F.concat(_jsonld_card(), _table_card(), _generic_card()))
    )
    url = F.concat(F.lit("https://www.example-jobs.com/company/"), F.col("s_suppkey").cast("string"))
    return _pages(j, card, url, wrap=("<section>", "</section>"))


def has_job_page() -> Column:
    """Data-driven: parts of size 10 and above have a crawled job page."""
    return F.col("p_size") >= 10


def job_page_url(prefix: str = "https://www.naukri.com/job-listings-r-") -> Column:
    return F.concat(F.lit(prefix), F.col("job_id").cast("string"))


def naukri_job_pages(spark, sf_dir, crawled_only: bool = False) -> DataFrame:
    """One Naukri job page per part (``LARGE`` parts omit the company).

    ``crawled_only`` leaves out the pages that a batch of links doesn't find,
    so that enrichment has links with and without a page.
    """
    j = job_rows(spark, sf_dir)
    j = j.where(has_job_page()) if crawled_only else j
    company = F.when(F.col("p_type") == "LARGE", F.lit("")).otherwise(
        F.concat(F.lit('<a class="jd-header-title-company" href="/c-jobs-careers-'), F.col("s_suppkey").cast("string"), F.lit('">'), esc("company"), F.lit("</a>"))
    )
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), esc("role"), F.lit("</title></head><body>"),
        F.lit('<div class="styles_jd-header"><h1 class="jd-header-title">'), esc("role"), F.lit("</h1>"), company, F.lit("</div>"),
        F.lit('<div class="styles_details"><span class="location">'), esc("nation"), F.lit(", "), esc(place(F.col("region"))),
        F.lit('</span><span class="exp">'), experience_text(), F.lit('</span><span class="education">Graduate - '), F.lower(F.col("p_type")), F.lit("</span></div>"),
        F.lit('<section class="job-desc"><div class="styles_JDC__dang-inner-html__x1"><ul><li>Build '), F.lower(F.col("p_type")),
        F.lit(" products for the "), esc("p_brand"), F.lit(" line.</li><li>Own size "), F.col("p_size").cast("string"),
        F.lit(" assemblies end to end</li><li>Work with the "), esc("nation"), F.lit(" team every week</li></ul></div></section>"),
        F.lit('<div class="key-skill"><a class="chip" href="/skills/b">'), esc("p_brand"), F.lit('</a><a class="chip" href="/skills/t">'),
        F.lower(F.col("p_type")), F.lit("</a></div>"),
        F.lit('<div class="other-details"><div>Employment Type: Full Time, Permanent</div><div>Department: Engineering - Hardware</div>'),
        F.lit("<div>Industry Type: "), F.initcap(F.col("p_type")), F.lit(" Goods</div></div></body></html>"),
    )
    return dealt(j).select(F.col("job_id").cast("bigint").alias("page_id"), job_page_url().alias("url"), html.alias("html"))


def generic_link_pages(spark, sf_dir) -> DataFrame:
    """Generic listing pages: one job card per part with a ``/jobs/<id>`` link."""
    j = job_rows(spark, sf_dir)
    company = F.when(no_company(), F.lit("")).otherwise(F.concat(F.lit('<span class="employer">'), esc("company"), F.lit("</span>")))
    card = F.concat(
        F.lit('<div class="job-card"><a href="/jobs/'), F.col("job_id").cast("string"), F.lit('">'), esc("role"), F.lit("</a>"), company, F.lit("</div>"),
    )
    url = F.concat(F.lit("https://careers.example.com/openings/"), F.col("s_suppkey").cast("string"))
    return _pages(j, card, url, wrap=("<section>", "</section>"))


def _sentences() -> list[Column]:
    """The three statements of a job description, as HTML."""
    return [
        F.concat(F.lit("Build "), F.lower(F.col("p_type")), F.lit(" products for the "), esc("p_brand"), F.lit(" line.")),
        F.concat(F.lit("Own size "), F.col("p_size").cast("string"), F.lit(" assemblies end to end")),
        F.concat(F.lit("Work with the "), esc("nation"), F.lit(" team every week")),
    ]


def _element(open_tag: str, inner: Column, close: str) -> Column:
    return F.concat(F.lit(open_tag), inner, F.lit(close))


def _whole(j: DataFrame, url: Column, *parts: Column) -> DataFrame:
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>Job</title></head><body>"), *parts, F.lit("</body></html>"))
    return dealt(j).select(F.col("job_id").cast("bigint").alias("page_id"), url.alias("url"), html.alias("html"))


def single_job_pages(spark, sf_dir, site: str) -> DataFrame:
    """One Indeed or LinkedIn job page per part.

    By ``p_size`` the title stands in the first, second or last place of its
    cascade or is missing, and so does the description; ``SMALL`` parts name no
    company.  Some pages hold none of the three.
    """
    j = job_rows(spark, sf_dir)
    a, b, c = _sentences()
    body = F.concat(F.lit("<p>"), a, F.lit("</p><ul><li>"), b, F.lit("</li><li>"), c, F.lit("</li></ul>"))
    if site == "Indeed":
        titles = ['<h1 class="jobsearch-JobInfoHeader-title">', '<h1 class="x-JobInfoHeader-y">', "<h1>"]
        company = _element('<div data-testid="inlineHeader-companyName">', esc("company"), "</div>")
        texts = [("<div id=\"jobDescriptionText\">", "</div>"), ("<div class=\"jobsearch-JobComponent-description\">", "</div>")]
        url = job_page_url("https://www.indeed.com/viewjob?jk=")
    elif site == "LinkedIn":
        titles = ['<h1 class="top-card-layout__title">', '<h1 class="x-title">', "<h1>"]
        company = F.when(F.col("p_size") % 2 == 0, _element('<a class="topcard__org-name-link">', esc("company"), "</a>")).otherwise(
            _element('<span class="topcard__flavor">', esc("company"), "</span>"))
        texts = [("<div class=\"show-more-less-html__markup\">", "</div>"), ("<section class=\"x-description\">", "</section>")]
        url = job_page_url("https://www.linkedin.com/jobs/view/")
    else:
        raise ValueError(site)
    title = F.lit("")
    for k, tag in enumerate(titles):
        title = F.when(F.col("p_size") % 5 == k + 1, _element(tag, esc("role"), "</h1>")).otherwise(title)
    text = F.lit("")
    for k, (tag, close) in enumerate(texts):
        text = F.when(F.col("p_size") % 3 == k, _element(tag, body, close)).otherwise(text)
    return _whole(j, url, title, F.when(no_company(), F.lit("")).otherwise(company), text)


def framed_pages(spark, sf_dir) -> DataFrame:
    """Job texts inside a site's furniture, some of it inside the main area."""
    j = job_rows(spark, sf_dir)
    a, b, c = _sentences()
    return _whole(
        j, job_page_url("https://careers.example.org/framed/"),
        F.lit('<header>Our jobs</header><nav><a href="/">Home</a></nav><main><div class="breadcrumb">Home / Jobs</div><p>'), a,
        F.lit('</p><div class="recommended">Similar jobs</div><p>'), b,
        F.lit('</p><script>var page = 1;</script></main><div class="site-sidebar">Adverts</div><p>'), c,
        F.lit('</p><div class="pagination">1 2 3</div><footer>Imprint</footer>'),
    )
