"""Extension rules: job page (F17), links (F18), enrichment (F19), page types."""

from pyspark.sql import functions as F

from jobsift.operators import enrich as E
from jobsift.operators import extract_extension as X
from jobsift.sources.shred import shred

from conftest import pad, pages_df


def page(spark, html, url):
    return shred(pages_df(spark, [(1, url, pad(html))]))


def test_job_page_exact_container_f17(spark):
    html = ('<h1 class="jd-header-title">Data Engineer</h1><a href="/acme-jobs-careers-1">Acme</a>'
            '<div class="JDC__dang-inner-html"><ul><li>Design data pipelines end to end</li><li>Own the warehouse and its models</li></ul></div>'
            '<span class="skill">SQL</span><span class="skill">SQL</span><div>Employment Type: Full Time\nDepartment: Data</div>')
    n = page(spark, html, "https://www.naukri.com/job-listings-data-engineer-1")
    r = n.select(X.scrape_page(F.col("url"), F.col("buf"), F.col("nodes")).alias("r")).first().r
    assert r.page_type == "job"
    d = r.data[0]
    assert (d.company, d.job_role) == ("Acme", "Data Engineer")
    assert d.description == "Design data pipelines end to end\nOwn the warehouse and its models"
    assert list(d.description_bullets) == ["Design data pipelines end to end", "Own the warehouse and its models"]
    assert list(d.skills) == ["SQL"]
    assert d.employment_type == "Full Time"


def test_job_page_fallback_and_sentinel(spark):
    body = "Company overview text.\nJob Description: " + "Build robust services for many users every day. " * 3 + "\nSimilar Jobs\nOther"
    html = f'<header class="header">Top nav</header><main><div class="job-header">x</div><p>{body}</p></main>'
    n = page(spark, html, "https://www.naukri.com/job-listings-x-2")
    r = n.select(X.scrape_page(F.col("url"), F.col("buf"), F.col("nodes")).alias("r")).first().r
    # job page by URL path + jd/job-header signal; no company or role found → sentinels → not accepted
    assert r.page_type == "job" and len(r.data) == 0
    j = n.select(X.naukri_job_page(F.col("url"), F.col("buf"), F.col("nodes")).alias("j")).first().j
    assert (j.company, j.job_role) == ("[COMPANY_NOT_FOUND]", "[ROLE_NOT_FOUND]")
    assert j.description.startswith(": Build robust services") and "Similar Jobs" not in j.description


def test_links_f18(spark):
    html = ('<div class="cust-job-tuple"><a href="/job-listings-a-1">Role A</a><a class="comp-name" href="/c">Acme</a></div>'
            '<div class="cust-job-tuple"><a href="/job-listings-a-1">Role A again</a></div>'
            '<li><p>Hiring now at Globex Corp today <a href="https://www.naukri.com/job-listings-b-2">Role B</a></p></li>')
    n = page(spark, html, "https://www.naukri.com/it-jobs?k=python")
    links = n.select(X.naukri_links(F.col("url"), F.col("buf"), F.col("nodes")).alias("l")).first().l
    assert [(x.url, x.company, x.role) for x in links] == [
        ("https://www.naukri.com/job-listings-a-1", "Acme", "Role A"),
        ("https://www.naukri.com/job-listings-b-2", "Globex", "Role B"),  # "(at|with|via) X" on an ancestor
    ]


def test_generic_links(spark):
    html = ('<div class="job-card"><a href="/jobs/1">One</a><span class="company">Acme</span></div>'
            '<div class="job-card"><a href="/jobs/1">Dup</a></div>')
    n = page(spark, html, "https://careers.example.com/list")
    links = n.select(X.generic_links(F.col("url"), F.col("buf"), F.col("nodes")).alias("l")).first().l
    assert [(x.url, x.company, x.role) for x in links] == [("https://careers.example.com/jobs/1", "Acme", "One")]


def test_enrichment_f19(spark):
    links = spark.createDataFrame(
        [(1, 1, "u1", "Card Co", "Card Role"), (1, 2, "u2", "Card Two", "R2"), (1, 3, "u3", "", "R3"), (1, 4, "u1", "Card Co", "Card Role")],
        "page_id long, pos int, url string, company string, role string")
    jobs = spark.createDataFrame(
        [("u1", "[COMPANY_NOT_FOUND]", "Real Role", "desc", [], [], "", "", "", "", "naukri-job-page")],
        "url string, company string, job_role string, description string, description_bullets array<string>, skills array<string>, "
        "education string, employment_type string, department string, industry string, source string")
    res, err = E.batch(links, jobs)
    got = sorted((r.pos, r.company, r.job_role, r.source) for r in res.collect())
    assert got == [(1, "Card Co", "Real Role", "naukri-job-page"), (2, "Card Two", "R2", "batch-card-fallback"),
                   (4, "Card Co", "Real Role", "naukri-job-page")]
    assert [(r.pos, r.error) for r in err.collect()] == [(3, "No data extracted")]


def test_upgrade_rules(spark):
    caps = spark.createDataFrame([("u", 1, "short"), ("u", 2, "much longer text"), ("v", 1, "x" * 150), ("v", 2, "y" * 200)],
                                 "url string, capture_no int, description string")
    best = {r.url: r.capture_no for r in E.upgrade_longest(caps).collect()}
    assert best == {"u": 2, "v": 2}
    batch = {r.url: r.capture_no for r in E.upgrade_if_short(caps).collect()}
    assert batch == {"u": 2, "v": 1}


def test_a_page_that_is_no_job_is_not_extracted_as_one(spark):
    """The empty job data of listings and unknown pages is a constant, not a record made and thrown away."""
    made = str(X.scrape_page(F.col("url"), F.col("buf"), F.col("nodes")))
    assert made.count("naukri-job-page") == 1 and made.count("generic-job-page") == 1
