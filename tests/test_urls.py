"""URL rules (O-C4 … O-C7, O-C10)."""

from pyspark.sql import functions as F

from jobsift.functions import urls as U

F5 = [
    ("https://www.indeed.com/jobs?q=python", True, False, False),
    ("https://www.google.com", False, False, False),
    ("https://www.linkedin.com/jobs/search?keywords=python", False, True, False),
    ("https://indeed.com/viewjob?jk=123", True, False, False),
    ("https://www.naukri.com/it-jobs", False, False, True),
    ("https://uk.indeed.com/jobs", True, False, False),
]


def test_domains_f5(spark):
    df = spark.createDataFrame([(u,) for u, *_ in F5], "url string")
    got = df.select(U.is_indeed_url("url"), U.is_linkedin_url("url"), U.is_naukri_url("url")).collect()
    assert [tuple(r) for r in got] == [tuple(x[1:]) for x in F5]


def test_detect_source_and_validity(spark):
    df = spark.createDataFrame([("https://www.linkedin.com/in/x",), ("HTTPS://x",), ("http://a.naukri.com/x",)], "url string")
    got = df.select(U.detect_source("url"), U.is_valid_url("url")).collect()
    assert [tuple(r) for r in got] == [("Generic", True), ("Generic", False), ("Naukri", True)]


def test_single_job(spark):
    df = spark.createDataFrame([("https://in.indeed.com/viewjob?jk=1",), ("https://www.linkedin.com/jobs/view/9",)], "url string")
    got = df.select(U.is_single_job_url("url", "Indeed"), U.is_single_job_url("url", "LinkedIn")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True)]


def test_pagination_f20(spark):
    rows = [
        ("https://x.com/s?start=0&restart=5", "Generic"),
        ("https://x.com/s?page=1", "Generic"),
        ("https://www.indeed.com/jobs?q=a", "Indeed"),
        ("https://x.com/s", "Generic"),
    ]
    df = spark.createDataFrame(rows, "url string, source string")
    out = df.select("url", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).join(df, "url").select(
        "url", "k", U.page_url("url", "source", "k").alias("p")).orderBy("url", "k").collect()
    got = {(r["url"], r["k"]): r["p"] for r in out}
    assert got[(rows[0][0], 1)] == "https://x.com/s?start=10&restart=10"
    assert got[(rows[0][0], 2)] == "https://x.com/s?start=20&restart=20"
    assert got[(rows[1][0], 2)] == "https://x.com/s?page=3"
    assert got[(rows[2][0], 1)] == "https://www.indeed.com/jobs?q=a&start=10"
    assert got[(rows[2][0], 2)] == "https://www.indeed.com/jobs?q=a&start=20"
    assert got[(rows[3][0], 0)] == "https://x.com/s" and got[(rows[3][0], 1)] is None


def test_link_patterns_f10(spark):
    """O-C14 + O-C15: one href per branch of the pattern rule, and the sample-link filter."""
    from jobsift.operators import classify as C

    hrefs = ["/job-listings-python-1", "/ai-jobs", "/python-jobs", "/Company/acme", "/about-us", "/a", "#top", "javascript:void(0)", ""]
    df = spark.createDataFrame([(h,) for h in hrefs], "href string")
    got = [tuple(r) for r in df.select(C.link_pattern("href"), C.sample_link("href")).collect()]
    assert got == [
        ("job-listings", True), ("filter-jobs", True), ("filter-jobs", True), ("company", True), ("other", True),
        (None, True), (None, False), (None, False), (None, False),
    ]
